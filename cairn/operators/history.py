"""The history of answered prompts: logged by mode, updated by facts that come later, looked up, measured, purged, replayed; and the reviews of what it proposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import store

#: Columns that hold what was said; kept in full mode only.
TEXTS = ("prompt_text", "rendered_text", "cwd")


def log(entries: DataFrame, mode: str = "full", excluded: DataFrame | None = None) -> DataFrame:
    """``entries`` (bundle_id, project_key, prompt_text, ...) as they are stored: ``off`` stores nothing, ``minimal`` no texts, ``full`` all; a project in ``excluded`` (project_key) is held to ``minimal``.
    The prompt's hash and number of words are always kept."""
    if mode not in ("full", "minimal", "off"):
        raise ValueError(mode)
    if mode == "off":
        return log(entries.limit(0), "minimal")
    out = entries.withColumn("prompt_hash", text.prompt_hash("prompt_text")).withColumn("prompt_words", F.regexp_count("prompt_text", F.lit(r"\S+")).cast("bigint"))
    full = F.lit(mode == "full")
    if excluded is not None:
        out = out.join(excluded.select("project_key").distinct().withColumn("_held", F.lit(True)), "project_key", "left")
        full = full & F.col("_held").isNull()
    kept = {c: F.when(full, F.col(c)).alias(c) for c in TEXTS}
    return out.select(*(kept.get(c, F.col(c)) for c in out.columns if c != "_held"))


def put(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Logging an entry again replaces the whole row."""
    return store.replace_by_key(stored, incoming, "bundle_id")


def fold(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Entries with what became known later: ``events`` (bundle_id, at, feedback, delivered_at), the last value of each that isn't null; events about unknown entries change nothing."""
    return entries.join(store.fold_events(events, "bundle_id", "at", "feedback", "delivered_at"), "bundle_id", "left")


def find(entries: DataFrame, *, project: str | None = None, source: str | None = None, served: bool | None = None, since: str | None = None, limit: int = 50) -> DataFrame:
    """The newest entries under all given conditions."""
    out = entries
    if project:
        out = out.where(F.col("project_key") == project)
    if source:
        out = out.where(F.col("source") == source)
    if served is not None:
        out = out.where(F.col("injected") == served)
    if since:
        out = out.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    out = out.orderBy(F.desc("created_at"), "bundle_id")
    return out.limit(limit) if limit else out


def resolve(entries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, bundle_id, state): the entry that a prefix of an id means; ``ambiguous`` or ``unknown`` where it doesn't mean one. An equi-join on prefixes of the lengths asked for."""
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]  # at most as many as an id has characters
    name = F.col("bundle_id").cast("string")
    cut = entries.select("bundle_id", F.explode(F.array(*(F.when(F.length(name) >= n, F.substring(name, 1, n)) for n in lengths or [1]))).alias("prefix"))
    met = prefixes.select("prefix").distinct().join(cut, "prefix", "left").groupBy("prefix").agg(F.count("bundle_id").alias("n"), F.min("bundle_id").alias("bundle_id"))
    state = F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return met.select("prefix", F.when(F.col("n") == 1, F.col("bundle_id")).alias("bundle_id"), state.alias("state"))


def purge(entries: DataFrame, before: Column) -> DataFrame:
    return entries.where(F.col("created_at") >= before)


def usage(entries: DataFrame) -> DataFrame:
    """One row of usage: counts, tokens, mean and 95th percentile of latency (nearest rank, halves to even), share of prompts that were given something, and of rated ones that were rated unhelpful."""
    n = lambda c: F.count_if(c)
    rated = n(F.col("feedback").isNotNull())
    whole = entries.agg(
        F.count("*").alias("bundles"), n(F.col("injected")).alias("injected"), n(~F.col("injected")).alias("skipped"), n(F.size("episodic_ids") > 0).alias("with_episodic"), n(F.size("cross_project_ids") > 0).alias("cross_project"),
        F.coalesce(F.sum(F.col("profile_tokens") + F.col("episodic_tokens") + F.col("evidence_tokens")), F.lit(0)).alias("tokens"), n(F.col("feedback")).alias("helpful"), n(~F.col("feedback")).alias("unhelpful"),
        F.round(F.avg("latency_ms"), 4).alias("mean_latency_ms"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        F.round(F.try_divide(n(F.col("injected")), F.count("*")), 6).alias("injection_rate"), F.round(F.try_divide(n(~F.col("feedback")), rated), 6).alias("false_injection_rate"),
    )
    late = store.nearest_rank_by(entries.select(F.lit(0).alias("all"), "latency_ms"), ["all"], "latency_ms", 0.95, "p95_latency_ms")
    return whole.withColumn("all", F.lit(0)).join(late, "all", "left").drop("all")


def usage_by(entries: DataFrame, column: str) -> DataFrame:
    """(column, n): entries of each task or project; none for those without."""
    return entries.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def suggestions(entries: DataFrame, most_chars: int = 160, among: int = 200, most: int = 6) -> DataFrame:
    """(prompt, project_key, created_at): of the newest served prompts the newest short ones, each wording once without case."""
    newest = find(entries, served=True, limit=among).select(F.trim("prompt_text").alias("prompt"), "project_key", "created_at", "bundle_id").where((F.length("prompt") > 0) & (F.length("prompt") <= most_chars))
    once = F.row_number().over(Window.partitionBy(F.lower("prompt")).orderBy(F.desc("created_at"), "bundle_id"))
    return newest.withColumn("n", once).where("n = 1").orderBy(F.desc("created_at"), "bundle_id").limit(most).select("prompt", "project_key", "created_at")


def replay_diff(logged: DataFrame, again: DataFrame, key: str, item: str) -> DataFrame:
    """(key, gone, new): what an answer held then and not now, and the other way round, sorted; keys of either side."""
    both = logged.groupBy(key).agg(F.collect_set(item).alias("then")).join(again.groupBy(key).agg(F.collect_set(item).alias("now")), key, "full_outer")
    none = F.array().cast(dict(logged.dtypes)[item].join(("array<", ">")))
    then, now = F.coalesce("then", none), F.coalesce("now", none)
    return both.select(key, F.array_sort(F.array_except(then, now)).alias("gone"), F.array_sort(F.array_except(now, then)).alias("new"))


def enqueue(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return store.replace_by_key(stored, incoming, "review_id")


def open_reviews(reviews: DataFrame) -> DataFrame:
    """What still waits for a decision, the weightiest first, of equal ones the oldest."""
    return reviews.where("resolution is null").orderBy(F.desc("impact"), "created_at", "review_id")


def resolved(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Reviews with the last decision of each from (review_id, at, resolution, note); decisions on unknown reviews change nothing."""
    last = events.groupBy("review_id").agg(F.max(F.struct("at", "resolution", "note")).alias("last"))
    joined = reviews.join(last, "review_id", "left")
    known = F.col("last").isNotNull()
    new = {"resolution": F.when(known, F.col("last.resolution")).otherwise(F.col("resolution")), "note": F.when(known, F.col("last.note")).otherwise(F.col("note")), "resolved_at": F.when(known, F.col("last.at")).otherwise(F.col("resolved_at"))}
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in reviews.columns))


def acceptance(reviews: DataFrame) -> DataFrame:
    """One row: how many decisions there are and the share that accepted the proposal."""
    done = reviews.where("resolution is not null")
    good = F.count_if(F.col("resolution").isin("supersede", "keep_both", "confirm"))
    return done.agg(F.count("*").alias("resolved"), good.alias("accepted"), F.count_if(F.col("resolution") == "reject").alias("rejected"), F.round(F.try_divide(good, F.count("*")), 6).alias("acceptance_rate"))
