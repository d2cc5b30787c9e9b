"""Ordered greedy selections, in which what is kept decides about what follows. A fold over one sorted array per group; groups must be bounded (a question's candidates are)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_budget(df: DataFrame, groups: Sequence[str], order: Sequence[Column], cost: str, budget: int, most: int = 1 << 30, stop: bool = False) -> DataFrame:
    """Rows that fit a budget, in order: one that is too big is skipped (or, with ``stop``, ends it); at most ``most``. Adds ``used``, the budget used so far."""
    row = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *(c for c in df.columns if c not in groups))
    listed = df.groupBy(*groups).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.lit(False).alias("over"), F.expr("cast(array() as array<boolean>)").alias("keep"), F.expr("cast(array() as array<bigint>)").alias("marks"))

    def step(acc: Column, x: Column) -> Column:
        c = x[cost].cast("bigint")
        fits = (acc["used"] + c <= budget) & (acc["n"] < most) & ~acc["over"]
        used = F.when(fits, acc["used"] + c).otherwise(acc["used"])
        return F.struct(used.alias("used"), (acc["n"] + fits.cast("int")).alias("n"), (acc["over"] | (F.lit(stop) & ~fits)).alias("over"), F.concat(acc["keep"], F.array(fits)).alias("keep"), F.concat(acc["marks"], F.array(used)).alias("marks"))

    folded = listed.withColumn("f", F.aggregate("rows", start, step))
    kept = F.explode(F.filter(F.arrays_zip("rows", F.col("f.keep").alias("keep"), F.col("f.marks").alias("used")), lambda z: z["keep"]))
    return folded.select(*groups, kept.alias("z")).select(*groups, *(F.col(f"z.rows.{c}").alias(c) for c in df.columns if c not in groups), F.col("z.used").alias("used"))
