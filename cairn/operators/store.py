"""Reads and writes of the knowledge store. Writes return new tables, for Parquet has no updates in place; see ``cairn.sources.snapshots`` for publishing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: str, first: dict[str, str] | None = None) -> DataFrame:
    """One row per key, the last by ``order`` (ties: the greatest row). ``first``: column -> order column, keeps that column's earliest value.

    One shuffle with partial aggregation, no sort of whole groups; null keys form a group."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max(F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rest if c not in order))).alias("newest")
    kept = [F.min_by(c, by).alias(f"_{c}") for c, by in (first or {}).items()]
    grouped = df.groupBy(*keys).agg(newest, *kept)
    return grouped.select(*((F.col(c) if c in keys else F.col(f"_{c}").alias(c) if c in (first or {}) else F.col(f"newest.{c}")) for c in df.columns))


def insert_new(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``stored`` and those of ``incoming`` whose key isn't there; of rows with one key the first by ``order``."""
    rest = [c for c in incoming.columns if c != key]
    once = incoming.groupBy(key).agg(F.min(F.struct(order, *(c for c in rest if c != order))).alias("r")).select(*((F.col(key) if c == key else F.col(f"r.{c}")) for c in incoming.columns))
    return stored.unionByName(once.join(stored.select(key), key, "left_anti"))


def replace_by_key(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of a key are replaced by the incoming ones."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def delete_by_key(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key), key, "left_anti")


def recount(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with ``chunk_count`` as counted."""
    counts = chunks.groupBy("document_id").agg(F.count("*").cast("int").alias("n"))
    return documents.join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("n", F.lit(0))).select(*documents.columns)


def records_where(records: DataFrame, *, projects: Sequence[int] = (), not_projects: Sequence[int] = (), types: Sequence[str] = (), least_confidence: float = 0.0, since: str | None = None, entities: Sequence[str] = (), superseded: bool = False, limit: int = 0) -> DataFrame:
    """Records under all given conditions, newest first; an empty or zero condition is none. Entities: any of them."""
    out = records
    if projects:
        out = out.where(F.col("project_id").isin(*projects))
    if not_projects:
        out = out.where(~F.col("project_id").isin(*not_projects))
    if types:
        out = out.where(F.col("record_type").isin(*types))
    if least_confidence > 0:
        out = out.where(F.col("confidence") >= least_confidence)
    if since:
        out = out.where(F.col("occurred_at") >= F.lit(since).cast("timestamp_ntz"))
    if not superseded:
        out = out.where("superseded_by is null")
    if entities:
        out = out.where(F.arrays_overlap(F.transform("entities", F.lower), F.array(*(F.lit(e.lower()) for e in entities))))
    if limit:
        out = out.orderBy(F.desc("occurred_at"), "record_id").limit(limit)
    return out


def statements_where(statements: DataFrame, *, statuses: Sequence[str] = ("active",), categories: Sequence[str] = (), entities: Sequence[str] = (), limit: int = 0) -> DataFrame:
    """Statements, surest first. The limit comes before the entity condition, which so may leave fewer."""
    out = statements
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    if categories:
        out = out.where(F.col("category").isin(*categories))
    if limit:
        out = out.orderBy(F.desc("confidence"), "statement_id").limit(limit)
    if entities:
        out = out.where(F.arrays_overlap("entities", F.array(*(F.lit(e.lower()) for e in entities))))
    return out


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group with their rank; Spark cuts each partition to k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= k)


def fold_events(events: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """The last known (non-null) value of each column per key: updates kept as facts."""
    return events.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in columns))


def snapshot_diff(before: DataFrame, now: DataFrame, key: str, version: str) -> DataFrame:
    """(key, ``change``): new, changed, unchanged or removed."""
    joined = before.select(F.col(key), F.col(version).alias("was")).join(now.select(F.col(key), F.col(version).alias("is")), key, "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(F.col("was") == F.col("is"), "unchanged").otherwise("changed")
    return joined.select(key, change.alias("change"))


def without_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    return rows.join(vectors.select(key), key, "left_anti")


def nearest_rank(values: Column, share: float) -> Column:
    """The value at a share of the way, by the nearest rank, halves to even: the project's percentile, not an interpolating one."""
    at = F.bround(F.lit(share) * (F.size(values) - 1)).cast("int")
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), at + 1))


def nearest_rank_by(df: DataFrame, groups: Sequence[str], value: str, share: float, name: str, bins: int = 4096) -> DataFrame:
    """(groups, ``name``): per group the value at a share of the way by the nearest rank, halves to even. Nulls are left out.

    Values are counted in equal bins between a group's least and greatest; only the rows of the bin that holds the rank are put in order. A bin of a few distinct values is counted, not sorted, so no group
    is sorted in one task unless a four-thousandth of its range holds nearly all of its distinct values."""
    v = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    spans = v.groupBy(*groups).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.count("*").alias("_n"))
    binned = v.join(spans, list(groups)).withColumn("_bin", F.when(F.col("_b") > F.col("_a"), F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins))).otherwise(0).cast("int"))
    counts = binned.groupBy(*groups, "_bin").agg(F.count("*").alias("_m"), F.first("_n").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*groups).orderBy("_bin")))  # at most as many rows a group as there are bins
    at = F.bround(F.lit(share) * (F.col("_n") - 1)).cast("bigint")
    wanted = upto.where((F.col("_upto") > at) & (F.col("_upto") - F.col("_m") <= at)).select(*groups, "_bin", (at - F.col("_upto") + F.col("_m")).alias("_at"))
    inside = binned.join(wanted, [*groups, "_bin"]).groupBy(*groups, "_v").agg(F.count("*").alias("_m"), F.first("_at").alias("_at"))
    placed = inside.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*groups).orderBy("_v")))
    return placed.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_m") <= F.col("_at"))).select(*groups, F.col("_v").alias(name))
