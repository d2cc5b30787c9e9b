"""Files below a root as documents: listed by Spark's binary reader, filtered by name, place, size and age, read as text."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.redact import is_sensitive_name

#: Kinds of files by suffix, and the largest file of each kind.
KINDS = {"md": "doc", "markdown": "doc", "txt": "doc", "rst": "doc", "py": "code", "ipynb": "notebook", "log": "log", "json": "results"}
MOST_BYTES = {"doc": 2_000_000, "code": 1_000_000, "notebook": 15_000_000, "log": 200_000_000, "results": 200_000}
#: Folders that are not entered, folders that hold results, names that are left out.
SKIPPED_FOLDERS = (
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", ".env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".idea", ".vscode", ".next", ".nuxt", ".gradle",
    ".cache", "cache", "dist", "build", "target", "site-packages", "vendor", "dataset", "datasets", "data", "images", "imgs", "frames", "wandb", "lightning_logs", "checkpoints", "weights",
    "tmp", "temp", ".dart_tool", "pods", "intermediates", "$recycle.bin", "system volume information", ".claude", ".codex", ".cursor", ".agents", ".gemini", ".continue",
)
RESULT_FOLDERS = ("experiments", "experiment", "working", "results", "runs", "logs", "output", "outputs")
SKIPPED_NAMES = ("package.json", "package-lock.json", "tsconfig*.json", "*.min.*", ".env*", "credentials*", "secret*", "*.pem", "*.key", "requirements*.txt", "license*", "*.lock", "composer.json", "*.map", "*.d.ts")
FLOOD, LOG_TAIL, SETTLING_S = 150, 1_000_000, 1800


def glob_pattern(glob: str) -> str:
    """A name glob as a regular expression that Java reads."""
    return fnmatch.translate(glob.lower()).replace("\\Z", "$").replace("\\z", "$").replace("(?s:", "(?s)(?:")


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """Is a path (relative, with slashes) under an ignore rule? ``name`` anywhere, ``folder/`` folders only, ``/a/b*`` from the root; without case."""
    low, out = F.lower(path), F.lit(False)
    for rule in rules:
        body = glob_pattern(rule.strip("/")).replace("(?s)(?:", "(?:").rstrip("$").removesuffix(")") + ")"
        start = "^" if rule.startswith("/") or "/" in rule.strip("/") else "(?:^|/)"
        out = out | low.rlike(start + body.replace(".*", "[^/]*") + ("/" if rule.endswith("/") else "(?:/|$)"))
    return out


def walk(spark: SparkSession, root: str, *, ignore: Sequence[str] = (), now: Column | None = None, flood: int = FLOOD) -> DataFrame:
    """(uri, path, folder, suffix, kind, length, modified): files worth reading; contents are not read (the reader prunes that column).

    A suffix with more than ``flood`` files in one folder is a data dump and is left out; files touched within the settling time before ``now`` wait."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    base = F.lit(root.rstrip("/").removeprefix("file:").replace("//", "/", 1) if root.startswith("file:") else root.rstrip("/"))
    at = F.substring("path", F.instr(F.col("path"), base) + F.length(base) + 1, F.length("path"))
    f = raw.withColumn("uri", F.col("path")).withColumn("path", at)
    f = f.withColumn("name", F.lower(F.element_at(F.split("path", "/"), -1))).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("suffix", F.regexp_extract("name", r"\.([a-z0-9]+)$", 1))
    kinds = F.create_map(*(F.lit(x) for p in KINDS.items() for x in p))
    sizes = F.create_map(*(F.lit(x) for p in MOST_BYTES.items() for x in p))
    f = f.withColumn("kind", F.try_element_at(kinds, F.col("suffix"))).where("kind is not null")
    folders = F.split(F.lower("folder"), "/")
    f = f.where((F.col("length") > 0) & (F.col("length") <= F.element_at(sizes, F.col("kind"))) & ~F.arrays_overlap(folders, F.array(*(F.lit(x) for x in SKIPPED_FOLDERS))))
    f = f.where((F.col("kind") != "results") | F.arrays_overlap(folders, F.array(*(F.lit(x) for x in RESULT_FOLDERS))))
    f = f.where(~F.col("name").rlike("|".join(f"(?:{glob_pattern(g)})" for g in SKIPPED_NAMES)) & ~is_sensitive_name(F.col("path")))
    if ignore:
        f = f.where(~ignored(F.col("path"), ignore))
    if now is not None:
        f = f.where(F.col("modified") < now - F.make_dt_interval(secs=F.lit(SETTLING_S)))
    full = f.groupBy("folder", "suffix").count().where(F.col("count") > flood)
    return f.join(full, ["folder", "suffix"], "left_anti").drop("name")


def read_text(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """``files`` with ``text``: UTF-8 with replacement; of logs only the end."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("uri"), "content")
    data = F.when(F.col("kind") == "log", F.expr(f"substring(content, greatest(1, length(content) - {LOG_TAIL} + 1), {LOG_TAIL})")).otherwise(F.col("content"))
    return files.join(content, "uri").withColumn("text", F.make_valid_utf8(data.cast("string"))).drop("content")
