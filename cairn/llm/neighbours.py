"""The k most similar vectors of every vector: stable projections, kd-trees and a chi-square stopping test.

Vectors are made unit, so that a cosine c is a squared distance 2 - 2 c. A Gaussian projection is 2-stable: along a Gaussian direction two vectors at distance d differ by d times a standard normal
variable, and over m directions their squared projected distance is d^2 times a chi-square of m degrees. Both facts bound a search, with d the distance of the k-th best neighbour found so far
or that of the similarity floor, whichever is less:

* A kd-tree cuts all rows at medians of one stable direction a level. The neighbour looked for lies beyond a plane at distance t with probability (1 - chi2_1(t^2 / d^2)) / 2, so every leaf has a
  probability, the product over its planes. A row goes to leaves in falling order of it, over several trees, until the probability that such a neighbour lies in none of them is below
  1 - ``confidence``; then its search stops. So a row is sent to the leaves its own bound reaches and to no others, rows without neighbours included.
* In a leaf, the k projected neighbours nearest over ``wide`` directions are compared first and tighten the row's bound; of the others only those within d^2 times the chi-square quantile are.

Trees are searched in ``phases``: what the first phase finds bounds the next, and a row whose stopping test holds already is sent nowhere. Leaves have about ``leaf_rows`` rows; a node above
four times that is split again at its own medians (``split_rounds`` times), and what can't be split is compared in chunks, each of bounded size, so no task holds an unbounded group.
What is shuffled is a rotated vector of one byte a coordinate, which gives similarities to about 0.001; the best of them, with a margin of ``MARGIN``, are taken again from the whole vectors.

Growth: a row is compared with ``leaf_rows`` times the number of leaves it visits, and that number grows as a small power of the number of leaves (the README has measured figures), where
comparing all pairs would grow in proportion to it.

Equal vectors are collapsed before and come back after: of a group of copies only the smallest k + 1 ids can be anyone's neighbours (ties go to the smaller id), so a group of
any size costs one row a member.

Defined cases: null ids are ignored; a repeated id counts once (its greatest vector by hash); vectors that are null, of another length, with null, NaN or infinite entries, or zero take
no part; ties go to the smaller id; fewer than k others above the floor give fewer rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.durable import durable
from cairn.session import ship

#: The error of a similarity taken from bytes, about six standard deviations.
MARGIN = 0.003
#: Levels that one round of splitting may add, and the most levels of the first cut.
SPLIT_LEVELS, MOST_LEVELS = 8, 24


def chi_square(m: int, confidence: float) -> float:
    """The quantile of a chi-square of m degrees, by bisection on the regularised incomplete gamma function (a series)."""

    def below(x: float) -> float:
        term = total = 1.0 / math.gamma(m / 2 + 1) if m < 300 else 0.0
        for n in range(1, 2000):
            term *= (x / 2) / (m / 2 + n)
            total += term
            if term < total * 1e-14:
                break
        return total * math.exp(m / 2 * math.log(x / 2) - x / 2)

    low, high = 1e-9, m + 40 * math.sqrt(m) + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < confidence else (low, middle)
    return high


@lru_cache(maxsize=1)
def _tail_table() -> tuple[np.ndarray, np.ndarray]:
    z = np.linspace(0, 8, 16_001)
    return z, np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z])


def beyond(margin: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The probability that a point at this distance lies beyond a plane: half the upper tail of a chi-square of one degree at (margin / distance)^2."""
    z, tail = _tail_table()
    return np.interp(np.abs(margin) / np.maximum(distance, 1e-6), z, tail, right=0.0)


@lru_cache(maxsize=4)
def rotation(length: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20_240_607).standard_normal((length, length)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


@lru_cache(maxsize=4)
def directions(length: int, trees: int, depth: int) -> np.ndarray:
    """(tree, coordinate, level): the stable directions of every tree's levels."""
    return np.random.default_rng(7_919).standard_normal((trees, length, depth)).astype(np.float32)


def _floats(rows: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.float32).reshape(-1, length)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def packed(x: np.ndarray) -> list[bytes]:
    """Rotated unit vectors as a scale (float32) and one signed byte a coordinate."""
    y = x @ rotation(x.shape[1])
    scale = np.maximum(np.abs(y).max(axis=1), 1e-12) / 127
    whole = np.rint(y / scale[:, None]).astype(np.int8)
    return [s.tobytes() + w.tobytes() for s, w in zip(scale.astype(np.float32), whole)]


def unpacked(rows: list[bytes], length: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), length + 4)
    scale = raw[:, :4].copy().view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * scale


class Planes:
    """The first cut of every tree: at a level one direction, at each node its own median where the sample has enough rows for it, else the level's."""

    def __init__(self, sample: np.ndarray, trees: int, levels: int, depth: int, least: int = 200):
        self.trees, self.levels, self.depth, self.length = trees, levels, depth, sample.shape[1]
        self.at: list[list[np.ndarray]] = []
        for tree in range(trees):
            y = sample @ directions(self.length, trees, depth)[tree, :, :levels]
            node, cuts = np.zeros(len(y), dtype=np.int64), []
            for level in range(levels):
                pooled = float(np.median(y[:, level])) if len(y) else 0.0
                if len(y) >= least << level:
                    values = np.full(1 << level, pooled)
                    order = np.argsort(node, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                        values[node[part[0]]] = np.median(y[part, level])
                else:
                    values = np.array([pooled])
                cuts.append(values)
                node = 2 * node + (y[:, level] >= values[node if len(values) > 1 else np.zeros_like(node)])
            self.at.append(cuts)

    def project(self, x: np.ndarray, tree: int) -> np.ndarray:
        return x @ directions(self.length, self.trees, self.depth)[tree, :, : self.levels]

    def margin(self, y: np.ndarray, tree: int, level: int, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        cuts = self.at[tree][level]
        return y[row, level] - cuts[node if len(cuts) > 1 else np.zeros_like(node)]

    def own(self, y: np.ndarray, tree: int, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf, and the probability that a neighbour at its distance shares it."""
        row, node, p = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), np.ones(len(y))
        for level in range(self.levels):
            m = self.margin(y, tree, level, row, node)
            p *= 1 - beyond(m, distance)
            node = 2 * node + (m >= 0)
        return node, p

    def near(self, y: np.ndarray, tree: int, distance: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, probability) of all leaves of at least that probability."""
        row, node, p = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), np.ones(len(y))
        for level in range(self.levels):
            m = self.margin(y, tree, level, row, node)
            other = p * beyond(m, distance[row])
            bit = (m >= 0).astype(np.int64)
            row, node, p = np.concatenate([row, row]), np.concatenate([2 * node + bit, 2 * node + 1 - bit]), np.concatenate([p - other, other])
            keep = p >= least
            row, node, p = row[keep], node[keep], p[keep]
        return row, node, p


def _until(row: np.ndarray, p: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions to take, per row by falling probability until the logarithm of the chance of a miss is at its goal; and the rows that never get there."""
    order = np.lexsort((-p, row))
    r = row[order]
    chance = np.log1p(-np.minimum(p[order], 1 - 1e-12))
    whole = np.cumsum(chance)
    first = np.searchsorted(r, r, side="left")
    before = np.where(first > 0, whole[np.maximum(first - 1, 0)], 0.0)
    taken = whole - chance - before > goal[r]  # not there yet when this one's turn comes
    total = np.zeros(len(goal))
    np.add.at(total, row, np.log1p(-np.minimum(p, 1 - 1e-12)))
    return order[taken], np.flatnonzero(total > goal + 1e-9)


def leaves_to_visit(planes: Planes, x: np.ndarray, bound: np.ndarray, trees: range, confidence: float, phases: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree, leaf) of a phase's trees beside each row's own leaves, until its stopping test holds."""
    distance, whole = np.sqrt(bound), math.log(1 - confidence)
    # What earlier phases have seen: at least the rows' own leaves at today's distance, and at least what their stopping test asked for.
    goal, at = np.full(len(x), whole), 0
    for n in phases:
        if at >= trees.start:
            break
        seen = sum(np.log1p(-np.minimum(planes.own(planes.project(x, t), t, distance)[1], 1 - 1e-12)) for t in range(at, at + n))
        goal = goal - np.minimum(seen, whole * n / planes.trees)
        at += n
    share = whole * len(trees) / max(1, planes.trees)
    goal = np.where(goal < 0, np.maximum(goal, share), 1.0)
    open_ = np.flatnonzero(goal < 0)
    found, least = [], 0.05
    ys = {t: planes.project(x, t) for t in trees}
    while len(open_):
        parts = []
        for t in trees:
            row, node, p = planes.near(ys[t][open_], t, distance[open_], least)
            parts.append((row, np.full(len(row), t), node, p))
        row, tree, node, p = (np.concatenate(c) for c in zip(*parts))
        taken, short = _until(row, p, goal[open_])
        done = np.ones(len(open_), dtype=bool)
        done[short] = False
        taken = taken[done[row[taken]]]
        found.append((open_[row[taken]], tree[taken], node[taken]))
        open_, least = open_[short], least / 4
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    row, tree, node = (np.concatenate(c) for c in zip(*found))
    keep = np.ones(len(row), dtype=bool)
    for t in trees:
        mine = planes.own(ys[t], t, distance)[0]
        at_t = tree == t
        keep[at_t] = node[at_t] != mine[row[at_t]]
    return row[keep], tree[keep], node[keep]


def _compare(a: np.ndarray, b: np.ndarray, bound_a: np.ndarray, bound_b: np.ndarray, same: bool, floor: float, k: int, wide: int, wide_q: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i of a, j of b, similarity) that can be among the k best of either; with ``same`` every pair comes once. Distances over ``wide`` rotated coordinates, scaled to unit variance, come first."""
    scale = a.shape[1]
    pa_, pb = a[:, :wide], b[:, :wide]
    near = ((pa_**2).sum(axis=1)[:, None] + (pb**2).sum(axis=1)[None, :] - 2 * (pa_ @ pb.T)) * scale
    if same:
        np.fill_diagonal(near, np.inf)
    bound_a, bound_b = bound_a.copy(), bound_b.copy()
    for bound, d, x, y in ((bound_a, near, a, b),) if same else ((bound_a, near, a, b), (bound_b, near.T, b, a)):
        if d.shape[1] > k:
            first = np.argpartition(d, k - 1, axis=1)[:, :k]
            s = np.einsum("ij,ikj->ik", x, y[first]).min(axis=1)  # the k nearest projected neighbours: the worst of them bounds the row
            np.minimum(bound, np.maximum(2 - 2 * s, 0) + 2 * MARGIN, out=bound)
    if same:
        bound_b = bound_a
    i, j = np.nonzero(near <= wide_q * np.maximum(bound_a[:, None], bound_b[None, :]))
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j, np.zeros(0)
    if len(i) > near.size // 20:
        s = (a @ b.T)[i, j]
    else:
        s = np.concatenate([np.einsum("ij,ij->i", a[i[n : n + 20_000]], b[j[n : n + 20_000]]) for n in range(0, len(i), 20_000)])
    keep = s >= floor - MARGIN
    return i[keep], j[keep], s[keep].astype(np.float64)


def _best(q: np.ndarray, n: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each q the k best and all within the margin of the last of them."""
    order = np.lexsort((-s, q))
    q, n, s = q[order], n[order], s[order]
    start = np.searchsorted(q, q, side="left")
    end = np.searchsorted(q, q, side="right")
    keep = s >= s[np.minimum(start + k, end) - 1] - 2 * MARGIN
    return q[keep], n[keep], s[keep]


def _search_udf(length: int, floor: float, k: int, wide: int, wide_q: float, block: int = 4096):
    """Rows sorted by (tree, node, chunk, role) to directed candidates. A leaf's own rows (role 0, of bounded number) are held, its visitors pass by in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(q, n, s):
            q, n, s = _best(np.concatenate([q, n]), np.concatenate([n, q]), np.concatenate([s, s]), k)
            return pa.record_batch([pa.array(q), pa.array(n), pa.array(s)], names=["q", "n", "s"])

        def own(held):
            name, rot, bound = (np.concatenate([h[0] for h in held]), [r for h in held for r in h[1]], np.concatenate([h[2] for h in held]))
            x = unpacked(rot, length)
            i, j, s = _compare(x, x, bound, bound, True, floor, k, wide, wide_q)
            return (name, x, bound), emit(name[i], name[j], s)

        key, held, leaf = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            names, rots, bounds = batch.column(4).to_numpy(), batch.column(5), batch.column(6).to_numpy().astype(np.float32)
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                where, role = tuple(keys[a, :3]), keys[a, 3]
                if where != key:
                    if held:
                        yield own(held)[1]
                    key, held, leaf = where, [], None
                if role == 0:
                    held.append((names[a:b], rots.slice(a, b - a).to_pylist(), bounds[a:b]))
                    continue
                if held:
                    leaf, out = own(held)
                    held = []
                    yield out
                if leaf is None:  # a leaf without rows of its own
                    continue
                for c in range(a, b, block):
                    e = min(c + block, b)
                    x = unpacked(rots.slice(c, e - c).to_pylist(), length)
                    i, j, s = _compare(x, leaf[1], bounds[c:e], leaf[2], False, floor, k, wide, wide_q)
                    if len(i):
                        yield emit(names[c:e][i], leaf[0][j], s)
        if held:
            yield own(held)[1]

    return run


ROWS = "tree int, node bigint, chunk int, role int, vec bigint, rot binary, bound float"


def _rows(tree, node, chunk, role, vec, rot: pa.Array, at: np.ndarray, bound) -> pa.RecordBatch:
    n = len(at)
    fill = lambda v, kind: pa.array(np.broadcast_to(np.asarray(v), n).astype(kind))
    return pa.record_batch([fill(tree, np.int32), fill(node, np.int64), fill(chunk, np.int32), fill(role, np.int32), pa.array(vec[at]), rot.take(pa.array(at)), pa.array(bound[at].astype(np.float32))], names=["tree", "node", "chunk", "role", "vec", "rot", "bound"])


def _assign_udf(planes: Planes, length: int, trees: range, confidence: float, phases: tuple[int, ...]):
    """(vec, raw, rot, bound) to the rows of leaves: each row at home in its own leaf of every tree and visiting others. A node is numbered as in a heap, its root 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = 1 << planes.levels
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x = _unit(_floats(batch.column(1).to_pylist(), length))
                vec, rot, bound = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_numpy().astype(np.float64)
                for t in trees:
                    node, _ = planes.own(planes.project(x, t), t, np.sqrt(bound))
                    yield _rows(t, node + top, 0, 0, vec, rot, np.arange(len(x)), bound)
                row, tree, node = leaves_to_visit(planes, x, bound, trees, confidence, phases)
                if len(row):
                    yield _rows(tree, node + top, 0, 1, vec, rot, row, bound)

    return run


def _refine_udf(length: int, trees: int, depth: int, confidence: float):
    """Rows joined with a split node's medians (null: not split) to rows of its children; a row at home there visits its own child's siblings, as far as its bound reaches, as visitors do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, turn = directions(length, trees, depth), rotation(length)
        for batch in batches:
            table = {n: batch.column(n) for n in batch.schema.names}
            cuts = table["cuts"].to_pylist()
            stays = np.array([c is None for c in cuts], dtype=bool)
            if stays.any():
                yield batch.filter(pa.array(stays)).select(["tree", "node", "chunk", "role", "vec", "rot", "bound"])
            tree, node, role = (table[c].to_numpy() for c in ("tree", "node", "role"))
            vec, rot, bound = table["vec"].to_numpy(), table["rot"], table["bound"].to_numpy().astype(np.float64)
            for key in {(int(t), int(n)) for t, n, s in zip(tree, node, stays) if not s}:
                at = np.flatnonzero((tree == key[0]) & (node == key[1]) & ~stays)
                values = np.array(cuts[at[0]])
                level = key[1].bit_length() - 1
                y = unpacked(rot.take(pa.array(at)).to_pylist(), length) @ (turn.T @ g[key[0], :, level : level + len(values)]) - values
                d = np.sqrt(bound[at])
                row, child, p = np.arange(len(at)), np.zeros(len(at), dtype=np.int64), np.ones(len(at))
                mine = ((y >= 0) * (1 << np.arange(len(values) - 1, -1, -1))).sum(axis=1)
                for n in range(len(values)):
                    other = p * beyond(y[row, n], d[row])
                    bit = (y[row, n] >= 0).astype(np.int64)
                    row, child, p = np.concatenate([row, row]), np.concatenate([2 * child + bit, 2 * child + 1 - bit]), np.concatenate([p - other, other])
                taken, _ = _until(row, p, np.full(len(at), math.log(1 - confidence)))
                row, child = row[taken], child[taken]
                home = role[at] == 0
                visit = ~(home[row] & (child == mine[row]))
                base = key[1] << len(values)
                yield _rows(key[0], base + mine[home], 0, 0, vec, rot, at[home], bound)
                if visit.any():
                    yield _rows(key[0], base + child[visit], 0, 1, vec, rot, at[row[visit]], bound)

    return run


def _split(rows: DataFrame, length: int, trees: int, depth: int, confidence: float, leaf_rows: int, rounds: int) -> DataFrame:
    """Rows whose nodes are of bounded size: nodes above four times ``leaf_rows`` are split at their own medians, taken from a bounded sample of each, and what is left is cut into chunks."""
    most = 4 * leaf_rows

    def hot() -> DataFrame:
        return durable(rows.where("role = 0").groupBy("tree", "node").agg(F.count("*").alias("n")).where(F.col("n") > most), "hot")

    large = hot()
    g = lambda: directions(length, trees, depth)

    def medians(key, data):
        tree, node, n = key[0].as_py(), key[1].as_py(), data["n"][0].as_py()
        level = node.bit_length() - 1
        levels = max(0, min(SPLIT_LEVELS, math.ceil(math.log2(n / leaf_rows)), depth - level))
        y = unpacked(data["rot"].to_pylist(), length) @ (rotation(length).T @ g()[tree, :, level : level + levels])
        return pa.table([pa.array([tree], pa.int32()), pa.array([node], pa.int64()), pa.array([np.median(y, axis=0).tolist()], pa.list_(pa.float64()))], names=["tree", "node", "cuts"])

    for _ in range(rounds):
        if large.isEmpty():
            return rows
        few = rows.where("role = 0").join(large, ["tree", "node"]).where(F.pmod(F.xxhash64("vec"), F.col("n")) < 2000)
        cuts = durable(few.select("tree", "node", "n", "rot").groupBy("tree", "node").applyInArrow(medians, "tree int, node bigint, cuts array<double>"), "cuts")
        joined = rows.join(cuts.where(F.size("cuts") > 0), ["tree", "node"], "left").select("tree", "node", "chunk", "role", "vec", "rot", "bound", "cuts")
        rows = durable(joined.mapInArrow(_refine_udf(length, trees, depth, confidence), ROWS), "rows")
        large = hot()
    if large.isEmpty():
        return rows
    # Chunk h's rows are at home in h and visit the chunks after it; visitors go to every chunk.
    parts = F.ceil(F.col("n") / F.lit(most)).cast("int")
    cut = rows.join(large.select("tree", "node", parts.alias("parts")), ["tree", "node"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int"))
    cut = cut.withColumn("to", F.explode(F.when(F.col("role") == 0, F.sequence(F.col("own"), F.col("parts") - 1)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    role = F.when((F.col("role") == 0) & (F.col("to") == F.col("own")), 0).otherwise(1)
    return cut.select("tree", "node", F.col("to").alias("chunk"), role.alias("role"), "vec", "rot", "bound")


def _exact(pairs: DataFrame, vectors: DataFrame, length: int) -> DataFrame:
    """(a, b, s): pairs with the similarity of their whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_floats(batch.column(c).to_pylist(), length).astype(np.float64) for c in (2, 3))
            s = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s)], names=["a", "b", "s"])

    left, right = (vectors.select(F.col("vec").alias(e), F.col("raw").alias(f"raw_{e}")) for e in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "raw_a", "raw_b").mapInArrow(run, "a bigint, b bigint, s double")


def neighbours(
    df: DataFrame, id_col: str, vector_col: str, *, k: int = 5, floor: float = 0.65, length: int = 384, wide: int = 96, confidence: float = 0.95, wide_confidence: float = 0.999, leaf_rows: int = 1024, phases: tuple[int, ...] = (2, 4), sample: int = 20_000, split_rounds: int = 3, measure: Callable[[dict], None] | None = None
) -> DataFrame:
    """(``id``, ``neighbour``, ``similarity``, ``rank``): of each id up to k others, best first, at or above the floor. ``measure`` is given counts of what was searched."""
    spark = df.sparkSession
    ship(spark)
    wide = min(wide, length)
    wide_q = chi_square(wide, wide_confidence)
    v = F.col("vector")
    sound = (F.size(v) == length) & F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull()).where(sound)
    # Equal vectors fall together by their hash before anything else is done with them.
    named = source.select("id", F.xxhash64("vector").alias("vec")).groupBy("id").agg(F.max("vec").alias("vec"))
    members = durable(named, "members")
    vectors = source.select(F.xxhash64("vector").alias("vec"), "vector").groupBy("vec").agg(F.first("vector").alias("vector")).join(members.select("vec").distinct(), "vec", "left_semi")

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, length)
                yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(packed(_unit(raw)), pa.binary())], names=["vec", "raw", "rot"])

    indexed = durable(vectors.mapInArrow(prepared, "vec bigint, raw binary, rot binary"), "vectors")
    n = indexed.count()
    if n == 0:
        return members.select("id", F.lit(0).cast("bigint").alias("neighbour"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).where("false")
    levels = max(0, min(MOST_LEVELS, math.ceil(math.log2(n / leaf_rows))))
    phases = phases if levels else (1,)
    trees, depth = sum(phases), levels + SPLIT_LEVELS * split_rounds
    rate = min(1.0, 1.2 * sample / n)
    drawn = indexed.select("vec", "raw").where(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < int(rate * 1_000_000) + 1).orderBy(F.xxhash64("vec"), "vec").limit(sample)
    fitted = _unit(_floats([r.raw for r in drawn.select("raw").collect()], length)) if levels else np.zeros((0, length), dtype=np.float32)
    planes = Planes(fitted, trees, levels, depth)

    radius, at, found, bounds = 2 - 2 * floor + 2 * MARGIN, 0, None, None
    order = ["tree", "node", "chunk", "role"]
    for phase in phases:
        rows = indexed.withColumn("bound", F.lit(radius).cast("float"))
        if bounds is not None:
            rows = indexed.join(bounds, "vec", "left").withColumn("bound", F.coalesce(F.col("bound").cast("float"), F.lit(radius).cast("float")))
        placed = rows.select("vec", "raw", "rot", "bound").mapInArrow(_assign_udf(planes, length, range(at, at + phase), confidence, phases), ROWS)
        placed = _split(durable(placed, "placed"), length, trees, depth, confidence, leaf_rows, split_rounds)
        if measure:
            measure({"rows": n, "levels": levels, "trees": phase, "placed": placed.groupBy("role").count().toPandas().set_index("role")["count"].to_dict()})
        near = placed.repartition("tree", "node", "chunk").sortWithinPartitions(*order).mapInArrow(_search_udf(length, floor, k, wide, wide_q), "q bigint, n bigint, s double")
        near = durable(near.groupBy("q", "n").agg(F.max("s").alias("s")), "near")
        found = near if found is None else found.unionByName(near).groupBy("q", "n").agg(F.max("s").alias("s"))
        at += phase
        if at < trees:
            rank = Window.partitionBy("q").orderBy(F.desc("s"), "n")
            bounds = found.withColumn("place", F.row_number().over(rank)).where(F.col("place") == k).select(F.col("q").alias("vec"), (2 - 2 * F.col("s") + 2 * MARGIN).alias("bound"))
    # The k best by bytes and all within their error are taken again from the whole vectors.
    rank = Window.partitionBy("q").orderBy(F.desc("s"), "n")
    last = found.withColumn("place", F.row_number().over(rank)).where(F.col("place") == k).select("q", F.col("s").alias("last"))
    close = found.join(last, "q", "left").where(F.col("last").isNull() | (F.col("s") >= F.col("last") - 2 * MARGIN))
    pairs = close.select(F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b")).distinct()
    exact = durable(_exact(pairs, indexed, length).where(F.col("s") >= floor), "exact")
    both = exact.select(F.col("a").alias("q"), F.col("b").alias("n"), "s").union(exact.select(F.col("b").alias("q"), F.col("a").alias("n"), "s"))

    # Of a group of copies the smallest k + 1 ids can be neighbours, at similarity 1 of the group's own members.
    ranked = members.withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("place") <= k + 1).select("vec", F.col("id").alias("neighbour"))
    other = both.join(ranked.withColumnRenamed("vec", "n"), "n").select(F.col("q").alias("vec"), "neighbour", F.col("s").alias("similarity"))
    copied = members.groupBy("vec").count().where("count > 1").select("vec")
    own = ranked.join(copied, "vec").select("vec", "neighbour", F.lit(1.0).alias("similarity"))
    options = other.unionByName(own)
    best = Window.partitionBy("vec").orderBy(F.desc("similarity"), "neighbour")
    options = options.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    each = members.join(options, "vec").where("id <> neighbour")
    last_order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return each.withColumn("rank", F.row_number().over(last_order)).where(F.col("rank") <= k).select("id", "neighbour", "similarity", "rank")
