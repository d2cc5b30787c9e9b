"""Texts put into containers of fixed capacity, by conflict-constrained best fit.

Sizes are tokens; a token is one UTF-8 byte, so an exact size needs no tokenizer run. A text larger than a container, and only such a one, is cut, at character boundaries, into full
containers and a rest that is packed like any other item. Items are taken by falling size. Open containers are ordered by what is left in them; the search starts at the tightest remainder
that could hold the item and goes on to the next larger one until a compatible container is found. A container carries two bitmaps: of the sources and of the duplicate clusters (equal content) that it can
take no more of. A cluster's texts share a container only where it has more texts than there are containers to fill, and then in its even share; a source may fill its even share of a container's
items and one more. Clusters bind always. Sources yield in one case: where no open container is compatible with both, the tightest that is compatible with the cluster is taken before a new one is opened,
for a source with a third of all rows could not be packed otherwise.

Scale: items are spread over blocks by a hash of the id, so hot sources and clusters are split evenly; a block is a bounded number of items (``block_items``), known
before packing from one count. Only ids, sizes and hashes are shuffled, never texts. A block leaves at most a few open containers ill filled; those
below ``refill`` of the capacity are emptied and their items are packed again, in blocks of as many items, ``rounds`` times in all.

Defined cases: null ids are ignored and a repeated id counts once (its greatest size); null and empty texts need no container and get none; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.durable import durable
from cairn.session import ship


def quotas(items: list[tuple[int, int, int]], capacity: int) -> dict[int, int]:
    """How many items of a cluster a container may hold: one, or, where a cluster has more items than the least number of containers, its even share."""
    least = max(1, -(-sum(i[0] for i in items) // capacity))
    return {cluster: -(-n // least) for cluster, n in Counter(i[2] for i in items).items() if n > least}


class _Open:
    """Open containers by remainder, and within one remainder by the bitmap of the sources that they can take no more of."""

    def __init__(self) -> None:
        self.left: list[int] = []  # distinct remainders, ascending
        self.at: dict[int, dict[int, list[int]]] = {}

    def add(self, left: int, mask: int, c: int) -> None:
        if left not in self.at:
            bisect.insort(self.left, left)
            self.at[left] = {}
        self.at[left].setdefault(mask, []).append(c)

    def remove(self, left: int, mask: int, n: int) -> int:
        of = self.at[left]
        c = of[mask].pop(n)
        if not of[mask]:
            del of[mask]
            if not of:
                del self.at[left]
                self.left.pop(bisect.bisect_left(self.left, left))
        return c

    def find(self, least: int, source: int, fits) -> tuple[int, int, int] | None:
        """The tightest container of that remainder or more whose sources leave room and which ``fits``: (remainder, mask, place). All of a remainder are looked at before the next."""
        for i in range(bisect.bisect_left(self.left, least), len(self.left)):
            left = self.left[i]
            for mask, names in self.at[left].items():
                if not mask & source:
                    for n in range(len(names) - 1, -1, -1):
                        if fits(names[n]):
                            return left, mask, n
        return None


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The container of each item (size, source bit, cluster hash); items are taken as they come: equal ones together."""
    quota = quotas(items, capacity)
    least = max(1, -(-sum(i[0] for i in items) // capacity))
    share = {source: -(-n // least) + 1 for source, n in Counter(i[1] for i in items).items()}
    open_ = _Open()
    masks: list[int] = []  # sources that a container can take no more of
    counts: list[dict[int, int]] = []  # of sources that aren't at their share yet
    bitmaps: list[int] = []  # 1,024 bits a container: clusters that it can take no more of; a set bit is looked up in the exact counts
    exact: list[dict[int, int]] = []
    out: list[int] = []
    before, resume = None, 0
    for size, source, cluster in items:
        bit, most = 1 << (cluster & 1023), quota.get(cluster, 1)
        # Of a run of copies of one source, each finds the containers before its predecessor's taken by the cluster: the search goes on from there.
        start = max(size, resume) if (size, source, cluster) == before else size
        fits = lambda c: not bitmaps[c] & bit or exact[c].get(cluster, 0) < most
        found = open_.find(start, source, fits) or open_.find(start, 0, fits)
        if found is None:
            c, left = len(masks), capacity
            masks.append(0)
            counts.append({})
            bitmaps.append(0)
            exact.append({})
        else:
            left = found[0]
            c = open_.remove(*found)
        n = counts[c].get(source, 0) + 1
        counts[c][source] = n
        if n >= share[source]:
            masks[c] |= source
        exact[c][cluster] = exact[c].get(cluster, 0) + 1
        full = exact[c][cluster] >= most
        if full:
            bitmaps[c] |= bit
        before, resume = (size, source, cluster), (0 if found and found[1] & source else left) if full else max(left - size, size)
        if left > size:
            open_.add(left - size, masks[c], c)
        out.append(c)
    return out


def _udf(capacity: int, refill: float, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(block: int, rows: list[tuple]) -> pa.RecordBatch:
            # The largest clusters first: each copy needs a container of its own, which others then fill. Texts without copies follow by falling size.
            copies = Counter(r[4] for r in rows)
            rows.sort(key=lambda r: (-copies[r[4]], -r[2], r[4], r[3], r[0], r[1]))
            put = best_fit([(r[2], 1 << (r[3] & 63), r[4]) for r in rows], capacity)
            fill: dict[int, int] = {}
            for r, c in zip(rows, put):
                fill[c] = fill.get(c, 0) + r[2]
            done = [final or fill[c] >= refill * capacity for c in put]
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.record_batch(
                [pa.array([block] * len(rows), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(put, pa.int64()), pa.array(done, pa.bool_())],
                names=["block", "id", "piece", "size", "source", "cluster", "bin", "done"],
            )

        block, rows = None, []
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block and rows:
                    yield emit(block, rows)
                    rows = []
                block = b
                rows.append(tuple(row))
        if rows:
            yield emit(block, rows)

    return run


def pack(df: DataFrame, id_col: str = "doc_id", *, text_col: str = "text", source_col: str = "source", capacity: int = 4096, block_items: int = 20_000, refill: float = 0.97, rounds: int = 3) -> DataFrame:
    """One row per piece: ``id``, ``piece`` (from 0), ``n_pieces``, ``start_byte``, ``n_tokens``, ``container`` (a string), null without tokens."""
    ship(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.octet_length(text).alias("size"), F.xxhash64(F.col(source_col)).alias("source"), F.xxhash64(text).alias("cluster"), F.when(F.octet_length(text) > capacity, text).alias("large")
    )
    # The cuts of large texts: the last character boundary at or before each multiple of the capacity. Cut before the shuffle, so no text is moved.
    items = items.withColumn("cuts", F.when(F.col("large").isNotNull(), _cuts(capacity)("large"))).drop("large")
    items = durable(items.groupBy("id").agg(F.max(F.struct("size", "source", "cluster", "cuts")).alias("x")).select("id", "x.*"), "items")
    starts = F.coalesce("cuts", F.array(F.lit(0)))
    pieces = items.select("id", "size", "source", "cluster", starts.alias("starts")).select("id", "source", "cluster", "starts", F.col("size").alias("total"), F.posexplode("starts").alias("piece", "start_byte"))
    pieces = pieces.select("id", "piece", "start_byte", F.size("starts").alias("n_pieces"), (F.coalesce(F.try_element_at("starts", F.col("piece") + 2), "total") - F.col("start_byte")).alias("size"), "source", "cluster")
    pieces = durable(pieces, "pieces")
    waiting = pieces.where("size > 0").select("id", "piece", "size", "source", "cluster")
    schema = "block bigint, id bigint, piece int, size int, source bigint, cluster bigint, bin bigint, done boolean"
    placed, level = [], 0
    while True:
        n = waiting.count()
        blocks = max(1, -(-n // block_items))
        if n == 0:
            break
        keyed = waiting.withColumn("block", F.pmod(F.xxhash64("id", "piece", F.lit(level)), F.lit(blocks))).select("block", "id", "piece", "size", "source", "cluster")
        last = blocks == 1 or level + 1 == rounds
        run = keyed.repartition(min(blocks, 20_000), "block").sortWithinPartitions("block").mapInArrow(_udf(capacity, refill, last), schema)
        step = durable(run, "packed")
        placed.append(step.where("done").select("id", "piece", F.concat_ws("-", F.lit(level), "block", "bin").alias("container")))
        waiting = step.where("not done").select("id", "piece", "size", "source", "cluster")
        if last:
            break
        level += 1
    out = pieces.select("id", "piece", "n_pieces", "start_byte", F.col("size").alias("n_tokens"))
    if not placed:
        return out.withColumn("container", F.lit(None).cast("string"))
    union = placed[0]
    for more in placed[1:]:
        union = union.unionByName(more)
    return out.join(union, ["id", "piece"], "left")


def _cuts(capacity: int):
    @F.pandas_udf("array<int>")
    def cuts(texts):
        import pandas as pd

        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            data, at, n = text.encode(), [0], len(text.encode())
            while n - at[-1] > capacity:
                cut = at[-1] + capacity
                while cut > at[-1] + 1 and data[cut] & 0xC0 == 0x80:
                    cut -= 1
                at.append(cut)
            out.append(at)
        return pd.Series(out)

    return cuts
