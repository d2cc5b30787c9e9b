"""A statement's life: seeded as a proposal, activated, confirmed, superseded, retired; kept as events and folded when read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seed(stored: DataFrame, statements: DataFrame, least_words: int = 5) -> DataFrame:
    """New proposals: statements of at least five words that aren't stored yet, compared without case and surrounding space; loading twice adds nothing."""
    key = lambda c: F.lower(F.trim(c))
    fresh = statements.where(F.size(F.split(F.trim("statement"), r"\s+")) >= least_words).withColumn("_k", key("statement"))
    once = fresh.groupBy("_k").agg(*(F.min_by(c, "statement").alias(c) for c in statements.columns))
    return once.join(stored.select(key("statement").alias("_k")), "_k", "left_anti").drop("_k").withColumn("status", F.lit("proposed"))


def replay(statements: DataFrame, events: DataFrame, floor: float = 0.85) -> DataFrame:
    """Statements after their events (statement_id, event, at), in order: activate (sure enough and not superseded), confirm (wakes a dormant one), supersede, retire, reject.

    What can't be done from a state leaves it as it is. A fold over one statement's events, which are few."""
    listed = events.groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("at", "event"))).alias("events"))
    s = statements.join(listed, "statement_id", "left").withColumn("events", F.coalesce("events", F.expr("cast(array() as array<struct<at: timestamp_ntz, event: string>>)")))
    start = F.struct(F.col("status").alias("status"), F.col("last_confirmed_at").alias("confirmed"))

    def step(acc: Column, e: Column) -> Column:
        status, kind = acc["status"], e["event"]
        can = (kind == "activate") & (status != "superseded") & (F.col("confidence") >= floor)
        after = (
            F.when(can, "active").when((kind == "confirm") & (status == "dormant"), "active").when((kind == "supersede") & (status == "active"), "superseded").when((kind == "retire") & (status == "active"), "dormant").when((kind == "reject") & (status == "proposed"), "rejected").otherwise(status)
        )
        confirmed = F.when(can | ((kind == "confirm") & status.isin("active", "dormant")), e["at"]).otherwise(acc["confirmed"])
        return F.struct(after.alias("status"), confirmed.alias("confirmed"))

    folded = s.withColumn("_f", F.aggregate("events", start, step))
    return folded.withColumn("status", F.col("_f.status")).withColumn("last_confirmed_at", F.col("_f.confirmed")).drop("_f", "events")
