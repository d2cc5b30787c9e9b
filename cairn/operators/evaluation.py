"""Measures of retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked_metrics(served: DataFrame, query: str, position: str, gain: str, k: int) -> DataFrame:
    """Per query, of its first k served rows (position from 1, gain 0 or 1): precision over what was served, reciprocal rank, nDCG against the served gains in the best order."""
    hit = F.col(gain) == 1
    s = served.where(F.col(position) <= k).groupBy(query).agg(F.sum(gain).alias("hits"), F.count("*").alias("served"), F.coalesce(F.sum(F.when(hit, 1 / F.log2(F.col(position) + 1))), F.lit(0.0)).alias("dcg"), F.min(F.when(hit, F.col(position))).alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("hits")).cast("int")), F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1.0))
    ndcg = F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0)
    return s.select(query, F.round(F.col("hits") / F.col("served"), 6).alias(f"precision_at_{k}"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(ndcg, 6).alias(f"ndcg_at_{k}"))


def summary(per_query: DataFrame, *, precision: str, expected: str, served: str) -> DataFrame:
    """One row over all queries: mean precision, share of queries with something expected that were served, and of those with nothing expected that stayed silent."""
    return per_query.agg(
        F.round(F.avg(precision), 6).alias("mean_precision"),
        F.round(F.try_divide(F.count_if(F.col(expected) & F.col(served)), F.count_if(F.col(expected))), 6).alias("hit_rate"),
        F.round(F.try_divide(F.count_if(~F.col(expected) & ~F.col(served)), F.count_if(~F.col(expected))), 6).alias("silence_rate"),
    )
