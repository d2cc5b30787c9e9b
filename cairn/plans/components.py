"""Connected components of an undirected graph, without bringing links or labels to the driver.

Alternating large-star and small-star rounds (each a grouping of links by a vertex and a min over the group, both with map-side
combination) until no link changes; the driver only reads one number per round. Each round's links are a written table, so a lost
executor costs at most the round that is running.

Hot vertices: a round joins every link with the minimum of its vertex, which is one row a vertex, so a vertex with a third of all links
is split by the adaptive skew join and never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.durable import Durable


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(``vertex``, ``component``): for every vertex of a link the smallest vertex of its component.

    Nulls and self-links join nothing: a link with a null end is ignored, a self-link gives its vertex. An empty input gives an empty result.
    Raises if ``max_rounds`` rounds do not suffice (a component's diameter is halved or better in a round).
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    current = Durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    lonely = current.df.where("u = v").select(F.col("u").alias("vertex"))
    first = current
    for _ in range(max_rounds):
        # Large star: every larger neighbour is linked to the smallest vertex of the neighbourhood.
        both = current.df.where("u <> v")
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        step = Durable(large, "links")
        # Small star: every vertex and its smaller neighbours are linked to the smallest of them.
        low = step.df.groupBy("u").agg(F.min("v").alias("m"))
        joined = step.df.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = Durable(small, "links")
        same = _digest(after.df) == _digest(current.df.where("u <> v"))
        step.drop()
        if current is not first:
            current.drop()
        current = after
        if same:
            stars = current.df.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
            centres = current.df.select(F.col("v").alias("vertex"), F.col("v").alias("component"))
            return stars.union(centres).union(lonely.select("vertex", F.col("vertex").alias("component"))).groupBy("vertex").agg(F.min("component").alias("component"))
    raise RuntimeError(f"no stable components after {max_rounds} rounds")


def _digest(links: DataFrame) -> tuple[int, int, int]:
    row = links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30))), F.lit(0))).first()
    return tuple(row)
