"""Near-duplicate texts by meet-in-the-middle ball hashing over min-wise fingerprints.

A text is its set of hashed word n-grams (three words here, as the task states). It gets ``fingerprints`` short fingerprints, each of
``symbols`` independent min-wise symbols: two texts of similarity s agree in a symbol with probability s. The distance of two
fingerprints is the size of their symmetric difference as sets of (place, symbol), and the radius is two: one symbol replaced. Every
fingerprint emits all its variants within half the radius, that is with one symbol deleted, and so two fingerprints within the radius
meet in a common variant. Variants are shuffled by their hash; colliding pairs are deduplicated and verified in two steps: a
sketch of four bits of every symbol rejects pairs far below the threshold, and the word n-gram sets of the rest are compared exactly.

Bit fingerprints (a Hamming ball over 64 bits) do not do here: at similarity 0.5 two one-bit min-wise sketches differ in a quarter of
their bits, and a ball of that radius has far more members than any collection could emit.

With the defaults (16 fingerprints of 4 symbols, 64 variants a text) a pair is found with probability 1 - (1 - P)^16, where
P = s^4 + 4 s^3 (1 - s): 0.9975 at s = 0.5, 0.9997 at 0.55, 0.99999 at 0.6.

Texts with equal n-gram sets are collapsed before anything is emitted and come back as membership, so a group of copies, however
large, costs one row a copy. A variant that more than ``hot`` different texts share (say, through a common preamble) never becomes all their pairs: its texts are laid into blocks
of bounded size, each pair of blocks is compared by sketches in one task, and only pairs near enough come out.

Defined cases: null ids are ignored; repeated ids count once; null, empty and short texts (fewer words than ``words``) have no n-grams, so
no similarity to anything, and form a class of their own each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.components import components
from cairn.plans.durable import durable
from cairn.session import ship, spread

def _minima(value: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each of ``n`` hash functions, the least scrambled value of each (non-empty) row; ``first`` are the rows' offsets."""
    from cairn.llm.textvec import mix64

    for seed in mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)):
        x = (value ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        yield np.minimum.reduceat(x, first)


def _sets_udf(words: int, symbols: int):
    """(id, text) to (id, set_hash, size, sketch of four bits a symbol, n-grams as 32-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cairn.llm.textvec import Words, code_points, distinct_by_row, mix64, shingles

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                points, offsets = code_points(batch.column(1), lower=True)
                value, row = shingles(Words(points, offsets), words)
                value, row = value >> np.uint64(32), row
                value, ends = distinct_by_row(value, row, batch.num_rows)
                size, full = np.diff(ends), np.flatnonzero(np.diff(ends))
                total = np.zeros(batch.num_rows, dtype=np.uint64)
                sketch = np.zeros((-(-symbols // 16), batch.num_rows), dtype=np.uint64)
                if len(full):
                    scrambled = mix64(value)
                    total[full] = np.add.reduceat(mix64(scrambled + np.uint64(1)), ends[full])
                    for k, least in enumerate(_minima(scrambled, ends[full], symbols)):
                        sketch[k // 16, full] |= (mix64(least) & np.uint64(15)) << np.uint64(k % 16 * 4)
                total = mix64(total + size.astype(np.uint64))
                grams = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(value.astype(np.uint32).view(np.int32)))
                yield pa.record_batch(
                    [batch.column(0), pa.array(total.view(np.int64)), pa.array(size.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in sketch), grams],
                    names=["id", "set_hash", "size", *(f"s{k}" for k in range(len(sketch))), "grams"],
                )

    return run


def _near_in_blocks(most: int, threshold: float):
    """Of one pair of blocks of a hot variant (or one block with itself) the pairs whose sketches and sizes can be those of similar texts."""

    def run(key, data):
        i, j = key[1].as_py(), key[2].as_py()
        name, size, block = (data[c].to_numpy() for c in ("set_hash", "size", "block"))
        sketch = np.column_stack([data[c].to_numpy().view(np.uint64) for c in data.schema.names if c[0] == "s" and c[1:].isdigit()])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = [np.zeros((0, 2), dtype=np.int64)]
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            x = sketch[a][:, None, :] ^ sketch[right][None, :, :]
            x |= x >> np.uint64(2)
            x |= x >> np.uint64(1)
            differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=2, dtype=np.int64)
            p, q = size[a][:, None], size[right][None, :]
            u, v = np.nonzero((differ <= most) & (np.minimum(p, q) >= threshold * np.maximum(p, q)))
            pairs = np.column_stack([name[a][u], name[right][v]])
            out.append(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return run


def _variants_udf(fingerprints: int, symbols: int):
    """(set_hash, non-empty n-grams) to (variant, set_hash): every fingerprint's variants with one symbol deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cairn.llm.textvec import mix64

        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column(0).to_numpy()
            _, once = np.unique(name, return_index=True)  # copies in a batch emit once; the rest fall together after the shuffle
            batch = batch.take(pa.array(np.sort(once)))
            grams, name = batch.column(1), batch.column(0)
            first = grams.offsets.to_numpy()[:-1].astype(np.int64)
            value = mix64(grams.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64))
            minima = _minima(value, first - first[0], fingerprints * symbols)
            for f in range(fingerprints):
                group = [mix64(next(minima) + np.uint64(k)) for k in range(symbols)]
                for gone in range(symbols):
                    key = np.full(len(name), np.uint64(f * symbols + gone + 1))
                    for k in range(symbols):
                        if k != gone:
                            key = mix64(key * np.uint64(31) + group[k])
                    yield pa.record_batch([pa.array(key.view(np.int64)), name], names=["variant", "set_hash"])

    return run


class NearDuplicates:
    """``links``: pairs of different texts; ``pairs()``: pairs of ids; ``classes()``: one row per id."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, *, words: int = 3, threshold: float = 0.5, fingerprints: int = 16, symbols: int = 4, hot: int = 256, block_rows: int = 2000):
        ship(df.sparkSession)
        source = spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))).where("id is not null")
        n = fingerprints * symbols
        keep = [f"s{k}" for k in range(-(-n // 16))]
        schema = f"id bigint, set_hash bigint, size int, {', '.join(f'{c} bigint' for c in keep)}, grams array<int>"
        sets = durable(source.mapInArrow(_sets_udf(words, n), schema), "sets")
        #: Texts without n-grams are like no other: each stands for itself under its id. A repeated id counts once.
        own = F.when(F.col("size") > 0, F.col("set_hash"))
        self.members = sets.groupBy("id").agg(F.min(own).alias("set_hash"))
        some = sets.where("size > 0")

        # Two sets meet in a variant. Copies of a set emit the same rows, which fall together after the one shuffle.
        # The filter is one that every join would infer on its side: so all of them read the one shuffle.
        rows = some.select("set_hash", "grams").mapInArrow(_variants_udf(fingerprints, symbols), "variant bigint, set_hash bigint").where("variant is not null and set_hash is not null").repartition("variant").distinct()
        # How many texts share a variant is counted beside it, in the order that the join needs anyway. A hot variant stays out on one side, so it joins nothing.
        counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("variant")))
        x, y = counted.where(F.col("n") <= hot).drop("n").alias("x"), rows.alias("y")
        met = x.join(y, (F.col("x.variant") == F.col("y.variant")) & (F.col("x.set_hash") < F.col("y.set_hash")))
        met = met.select(F.col("x.set_hash").alias("a"), F.col("y.set_hash").alias("b")).distinct()

        # Symbols of a pair of similarity s differ in a share 1 - s; five standard deviations are left free.
        share = (1 - threshold) * 15 / 16
        most = int(n * share + 5 * (n * share * (1 - share)) ** 0.5)
        prints = some.groupBy("set_hash").agg(*(F.first(c).alias(c) for c in ["size", *keep]))
        left, right = (prints.select(F.col("set_hash").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in ["size", *keep])) for e in "ab")
        differ = sum((_unlike_symbols(F.col(f"{c}_a"), F.col(f"{c}_b")) for c in keep), F.lit(0))
        fits = F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b")
        crowd = counted.where(F.col("n") > hot).select("variant", "set_hash", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
        near = met.join(left, "a").join(right, "b").where((differ <= most) & fits).select("a", "b")
        own = F.pmod(F.xxhash64("set_hash"), F.col("blocks")).cast("int")
        put = crowd.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(prints, "set_hash")
        put = put.select("variant", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_hash", "size", *keep)
        near = near.unionByName(put.groupBy("variant", "i", "j").applyInArrow(_near_in_blocks(most, threshold), "a bigint, b bigint")).distinct()
        near = durable(near, "near")

        # The n-gram sets are shuffled once, to the ends of all pairs, and only the matched ones again, to their pairs.
        ends = near.select(F.explode(F.array("a", "b")).alias("set_hash"), "a", "b")
        grams = some.select("set_hash", "grams").dropDuplicates(["set_hash"])
        both = ends.join(grams, "set_hash")
        both = both.where("set_hash = a").select("a", "b", F.col("grams").alias("grams_a")).join(both.where("set_hash = b").select("a", "b", F.col("grams").alias("grams_b")), ["a", "b"])
        shared = F.size(F.array_intersect("grams_a", "grams_b"))
        similarity = shared / (F.size("grams_a") + F.size("grams_b") - shared)
        self._linked = durable(both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold), "linked")

    def _reps(self) -> DataFrame:
        return self.members.where("set_hash is not null").groupBy("set_hash").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))

    @property
    def links(self) -> DataFrame:
        """(a, b, similarity), a < b: pairs of different texts, each named by the smallest id among its copies."""
        reps = self._reps().select("set_hash", "rep")
        named = self._linked.join(reps.select(F.col("set_hash").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("set_hash").alias("b"), F.col("rep").alias("rb")), "b")
        return named.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "similarity")

    def pairs(self) -> DataFrame:
        """All pairs of ids, copies expanded: as many rows as there are such pairs, so only for a caller who asked for them."""
        copied = self._reps().where("copies > 1")
        spread = self._linked.select("a", "b").unionByName(copied.select(F.col("set_hash").alias("a"), F.col("set_hash").alias("b")))
        members = self.members.where("set_hash is not null")
        both = spread.join(members.select(F.col("set_hash").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("set_hash").alias("b"), F.col("id").alias("y")), "b")
        both = both.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def classes(self) -> DataFrame:
        """One row per id: its copies' representative, its class (the smallest id that it is linked with, directly or not), and the
        number of links of its text to different texts."""
        links = durable(self.links, "links")
        found = components(links).withColumnRenamed("vertex", "rep")
        ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        named = self.members.join(self._reps().select("set_hash", "rep"), "set_hash", "left").select("id", F.coalesce("rep", "id").alias("rep"))
        return named.join(found, "rep", "left").join(ends, "rep", "left").select("id", "rep", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _unlike_symbols(a, b):
    """In how many of its sixteen four-bit symbols does one word of a sketch differ from another's?"""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
