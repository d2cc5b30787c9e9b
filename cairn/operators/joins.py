"""Interval, as-of and sharing joins that need neither a cross join nor a range join over whole keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _seconds(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def first_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, seconds: float, *, id_col: str, tie: str) -> DataFrame:
    """For each left row the first right row of its keys within ``seconds`` after it; rows without one drop out.

    Time is cut into slots of the interval's length, so a left row meets only the right rows of its own slot and the next: an equi-join on (keys, slot), whose
    partners are bounded by what happens within two intervals. A hot key is spread over its slots."""
    slot = lambda c: F.floor(_seconds(c) / seconds)
    a = left.withColumn("_slot", F.explode(F.array(slot(left_at), slot(left_at) + 1)))
    b = right.withColumn("_slot", slot(right_at))
    met = a.join(b, [*keys, "_slot"]).where((F.col(right_at) >= F.col(left_at)) & (_seconds(right_at) <= _seconds(left_at) + seconds))
    extra = [c for c in right.columns if c not in keys and c not in (right_at, tie)]
    first = met.groupBy(id_col).agg(*(F.first(c).alias(c) for c in left.columns if c != id_col), F.min(F.struct(right_at, tie, *extra)).alias("_r"))
    return first.select(*left.columns, "_r.*")


def last_before(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, values: Sequence[str], slot_seconds: float = 86_400.0) -> DataFrame:
    """For each left row the last right row of its keys at or before it (ties: the greatest values); nulls where there is none.

    Both sides are laid into one sequence. Within (keys, day) a window carries the last right row forward; over days only one summary row per key and day is carried."""
    right_row = F.struct(F.col(right_at).alias("at"), *values)
    day = lambda c: F.floor(_seconds(c) / slot_seconds)
    a = left.select(*keys, F.struct(*left.columns).alias("_l"), F.col(left_at).alias("_at"), day(left_at).alias("_day"), F.lit(1).alias("_side"))
    b = right.select(*keys, F.col(right_at).alias("_at"), day(right_at).alias("_day"), F.lit(0).alias("_side"), right_row.alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_day").orderBy("_at", "_side").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    days = b.groupBy(*keys, "_day").agg(F.max("_r").alias("_last"))
    # The last right row of an earlier day, for every day that any row lies in.
    every = both.select(*keys, "_day").distinct().join(days, [*keys, "_day"], "left")
    carried = every.withColumn("_before", F.max("_last").over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "_day", "_before")
    found = both.withColumn("_now", F.max("_r").over(within)).where("_side = 1").join(carried, [*keys, "_day"])
    best = F.coalesce("_now", "_before")
    return found.select("_l.*", best["at"].alias(right_at), *(best[v].alias(v) for v in values)).drop(left_at)


def sharing_pairs(df: DataFrame, id_col: str, set_col: str) -> DataFrame:
    """(a, b), a < b: rows whose sets share an element, by an equi-join on elements."""
    e = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(set_col)).alias("element"))
    x, y = e.alias("x"), e.alias("y")
    return x.join(y, (F.col("x.element") == F.col("y.element")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
