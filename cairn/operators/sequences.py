"""Running values over long ordered sequences without a window over a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_count(df: DataFrame, keys: Sequence[str], at: str, tie: str, flag: str, name: str) -> DataFrame:
    """The running count of a flag by key in order of (at, tie)."""
    return running_sum(df, keys, at, tie, F.col(flag).cast("bigint"), name)


def running_sum(df: DataFrame, keys: Sequence[str], at: str, tie: str, value: Column, name: str) -> DataFrame:
    """The running sum by key in order of (at, tie): within (key, day), plus what the days before sum up to, so the rows of no key come together in one task."""
    day = df.withColumn("_day", F.to_date(at))
    one = value
    days = day.groupBy(*keys, "_day").agg(F.sum(one).alias("_n"))
    earlier = days.select(*keys, "_day", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_day").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return day.withColumn(name, F.sum(one).over(within)).join(earlier, [*keys, "_day"]).withColumn(name, F.col(name) + F.col("_before")).drop("_day", "_before")
