"""Commit messages read as records: what was decided or went wrong, why, and what was turned down."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import fixed_values as V
from cairn.functions import text


def subject(message: Column) -> Column:
    return F.trim(F.regexp_extract(message, r"^\s*([^\r\n]*)", 1))


def body(message: Column) -> Column:
    """All but the first line, without trailers and bare links."""
    lines = F.split(F.regexp_replace(message, r"^\s*[^\r\n]*\r?\n?", ""), r"\r?\n")
    return F.trim(F.array_join(F.filter(lines, lambda x: ~x.rlike(V.TRAILER)), "\n"))


def conventional(message: Column) -> Column:
    """Struct of type, scope and summary; of another form, empty type and scope and the whole first line."""
    s = subject(message)
    part = lambda i: F.regexp_extract(s, V.CONVENTIONAL, i)
    return F.struct(F.lower(part(1)).alias("type"), F.lower(part(2)).alias("scope"), F.when(part(1) != "", F.trim(part(4))).otherwise(s).alias("summary"))


def reverted(message: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(subject(message), r'(?i)^revert\s+"?(.+?)"?$', 1)), F.lit(""))


def merged_branch(message: Column) -> Column:
    name = F.regexp_extract(subject(message), r"(?i)^merge (?:branch|pull request #\d+ from|remote-tracking branch)\s+'?([^'\s]+)'?", 1)
    return F.nullif(F.regexp_replace(name, "^origin/", ""), F.lit(""))


def stated_reason(message: Column) -> Column:
    """The first line with a phrase of reason, else the first paragraph of thirty characters; at most 400 characters; null if there is none."""
    b = body(message)
    lines = F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-*# ]+", ""))), lambda x: F.length(x) >= 12)
    marked = F.get(F.filter(lines, lambda x: x.rlike("(?i)" + "|".join(V.REASONS))), F.lit(0))
    paragraph = F.get(F.filter(F.transform(F.split(b, "\n\n"), F.trim), lambda x: F.length(x) >= 30), F.lit(0))
    return F.coalesce(F.substring(marked, 1, 400), F.regexp_replace(F.substring(paragraph, 1, 400), "\n", " "))


def rejected(message: Column) -> Column:
    """Up to four alternatives that were dropped, distinct without case, in the order of the phrases."""
    found = F.flatten(F.array(*(F.regexp_extract_all(message, F.lit(p), 1) for p in V.ALTERNATIVES)))
    clean = F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[.,;:]+|[.,;:]+$", ""))), lambda x: (F.length(x) >= 2) & ~F.lower(x).isin("it", "this", "that", "them"))
    start = F.expr("cast(array() as array<string>)")
    once = F.aggregate(clean, start, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.slice(once, 1, 4)


def is_noise(message: Column) -> Column:
    """Is a commit never worth a record, by its first line?"""
    s = F.lower(subject(message))
    return (F.length(s) < 8) | s.rlike("|".join(f"(?:{p})" for p in V.NOISE_SUBJECTS))


def named(message: Column, files: Column | None = None, vocabulary: Sequence[str] = V.TECH_LEXICON) -> Column:
    """The terms of a vocabulary that a message names as words or that a path has as a whole component or a word of one, under their usual names, sorted.

    One pass of a single pattern over the message: longer terms come first where one begins another, and those within a found one are asked for by themselves."""
    low = F.lower(message)
    boundary = {w: [v for v in vocabulary if v != w and re.search(rf"(?<![a-z0-9]){re.escape(v)}\b", w)] for w in vocabulary}
    ordered = sorted(vocabulary, key=lambda w: (-len(w), w))
    found = F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9])(" + "|".join(re.escape(w) for w in ordered) + r")\b"), 1)
    inner = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*(F.lit(v) for v in x)) for w, vs in boundary.items() if vs for x in (w, vs)))
    found = F.concat(found, F.flatten(F.transform(found, lambda w: F.coalesce(F.try_element_at(inner, w), F.array().cast("array<string>")))))
    if files is not None:
        parts = F.flatten(F.transform(files, lambda f: F.split(F.replace(F.lower(f), F.lit("\\"), F.lit("/")), "/")))
        pieces = F.flatten(F.transform(parts, lambda x: F.concat(F.array(x), F.split(x, "[^a-z0-9]+"))))
        found = F.concat(found, F.array_intersect(F.coalesce(pieces, F.array().cast("array<string>")), F.array(*(F.lit(v) for v in vocabulary))))
    return F.array_sort(F.array_distinct(F.transform(found, text.normal_entity)))


def source_url(remote: Column, project: Column, sha: Column) -> Column:
    """A commit's address at its remote, where that is a web address, else within its project."""
    base = F.regexp_replace(remote, r"\.git$", "")
    return F.when(F.startswith(base, F.lit("http")), F.concat(base, F.lit("/commit/"), sha)).otherwise(F.concat(F.lit("git://"), project, F.lit("/commit/"), sha))


def failure(message: Column, reason: Column) -> Column:
    """What went wrong, or null: struct of record_type, what, outcome, confidence. A revert always counts; a fix or a word of failure does where it says enough and the author doesn't call it something else."""
    c, back = conventional(message), reverted(message)
    is_revert = back.isNotNull() | (c["type"] == "revert")
    word = message.rlike("(?i)" + "|".join(f"(?:{p})" for p in V.FAILURE_WORDS))
    detailed = reason.isNotNull() | word
    sure = F.when(reason.isNotNull(), F.least(F.lit(0.92), F.lit(0.8) + 0.05)).when(detailed, 0.8).otherwise(0.58)
    said = (~c["type"].isin(*V.NO_FAILURE_TYPES)) & ((c["type"] == "fix") | word) & (detailed | (F.length(c["summary"]) >= 30)) & ~is_noise(message)
    part = lambda kind, what, outcome, value: F.struct(F.lit(kind).alias("record_type"), F.substring(what, 1, 300).alias("what"), F.lit(outcome).alias("outcome"), value.alias("confidence"))
    return F.when(is_revert, part("reversal", F.concat(F.lit("Reverted: "), F.coalesce(back, c["summary"])), "reverted", F.lit(0.88))).when(said, part("failure", c["summary"], "fixed in this commit", sure))


def decision(message: Column, reason: Column, entities: Column, alternatives: Column) -> Column:
    """What was decided, or null, in the same form as ``failure``."""
    sure = confidence(message, reason, merged_branch(message), entities, alternatives)
    c = conventional(message)
    kept = sure.isNotNull() & ~is_noise(message) & ~(c["type"].isin(*V.UNINTERESTING_TYPES) & reason.isNull())
    return F.when(kept, F.struct(F.lit("decision").alias("record_type"), F.substring(c["summary"], 1, 300).alias("what"), F.lit("").alias("outcome"), sure.alias("confidence")))


def confidence(message: Column, reason: Column, merged: Column, entities: Column, alternatives: Column) -> Column:
    """How sure a decision is: a stated reason, a merged branch, or a longer feature commit that names something; null for what is no decision."""
    c = conventional(message)
    base = F.when(reason.isNotNull(), 0.85).when(merged.isNotNull(), 0.72).when(c["type"].isin("feat", "refactor", "perf") & (F.size(entities) > 0) & (F.length(c["summary"]) >= 24), 0.66)
    value = F.when(F.size(alternatives) > 0, F.least(F.lit(0.95), base + 0.05)).otherwise(base)
    return F.when(reverted(message).isNull() & (F.length(subject(message)) >= 8), value)
