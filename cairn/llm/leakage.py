"""Evaluation texts that leaked into a corpus: q-gram lemma filtering with banded verification.

Documents and evaluation passages are reduced to their words (after NFKC and lower-casing), joined by single spaces. For each passage the shortest
run of ``run`` consecutive words has m characters; a document region within ``edits`` edits of such a run shares at least m - q + 1 - edits * q of its character
q-grams with it, and these lie in a band of ``edits`` + 1 neighbouring diagonals (place in the passage minus place in the document). So

1. all q-grams of a document are looked up in a table of the evaluation q-grams;
2. hits are counted in diagonal bands that overlap by half, of twice the needed width, so that every run of neighbouring diagonals lies in one band whole;
3. (document, passage, band) regions whose hits come densely enough to meet the bound are retained;
4. retained regions are verified by an alignment in the band, with at most ``edits`` edits.

``exact`` asks for common runs of words: the same filter and alignment with an edit budget of 0, and of what is aligned the words must be equal too, for an alignment may begin or end within a word.
The filter loses nothing: a common run of words is a region with no edits.

The evaluation side is a stated query set. Up to ``index_chars`` characters (counted first) its q-grams are one index, sent to the executors, and the documents are passed over once. Beyond that nothing of it
comes to the driver: its q-grams are a table, a bitmap of fixed size tells the documents which of their q-grams occur in it, those alone are shuffled and joined, and each pair of document and passage that
shares enough of them (by the lemma) is aligned by itself.

Defined cases: null ids are ignored; a repeated id counts once; null and empty texts leak nothing; passages shorter than ``run`` words cannot leak;
null prompts and passages are skipped; extra columns are ignored; an empty side gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.durable import durable
from cairn.session import ship, spread

_BREAK = "￿"  # between the texts of a batch; not a character


def _normal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, one after another, and their offsets."""
    whole = _BREAK.join("" if t is None else t.replace(_BREAK, " ") for t in texts)
    if not whole.isascii():
        whole = unicodedata.normalize("NFKC", whole)
    points = np.frombuffer(whole.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    breaks = np.flatnonzero(points == 0xFFFF)
    return points, np.concatenate([[0], breaks + 1, [len(points) + 1]])


class _Text:
    """Word characters of a batch with one space between words: ``points``, ``row``; words: ``start``, ``end`` (in ``points``), ``word_row``, ``hash``."""

    def __init__(self, texts: list[str | None]):
        from cairn.llm.textvec import Words

        points, offsets = _normal(texts)
        inner = offsets.copy()
        inner[-1] -= 1
        words = Words(points, inner)
        self.hash, self.word_row, n = words.hash, words.row, len(words.start)
        length = words.end - words.start
        self.start = np.zeros(n, dtype=np.int64)
        if n:
            np.cumsum(length[:-1] + 1, out=self.start[1:])
        self.end = self.start + length
        total = int(self.end[-1]) + 1 if n else 0
        self.points = np.full(total, 32, dtype=np.uint32)
        if n:
            at = np.repeat(words.start - self.start, length)
            place = np.repeat(self.start - np.concatenate([[0], np.cumsum(length[:-1])]), length) + np.arange(int(length.sum()))
            self.points[place] = points[place + at]
        self.row = np.repeat(self.word_row, length + 1)

    def grams(self, q: int) -> np.ndarray:
        """A 64-bit hash of the q-gram that begins at each position (those that run over the end are cut off)."""
        from cairn.llm.textvec import mix64

        n = len(self.points) - q + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        value = np.zeros(n, dtype=np.uint64)
        for k in range(q):
            value = value * np.uint64(0x100000001B3 | 1) + self.points[k : k + n]
        return mix64(value)


class Passages:
    """A block of evaluation passages, prepared: q-gram table, bounds, runs of words."""

    def __init__(self, rows: list[tuple[int, str]], run: int, edits: int, q: int):
        self.run, self.edits, self.q = run, edits, q
        self.items = np.array([r[0] for r in rows], dtype=np.int64)
        text = _Text([r[1] for r in rows])
        self.text = text
        first = np.searchsorted(text.word_row, np.arange(len(rows) + 1))
        grams = text.grams(q)
        keep, need = [], np.full(len(rows), np.iinfo(np.int32).max, dtype=np.int64)
        self.span = np.zeros(len(rows), dtype=np.int64)
        self.origin = np.zeros(len(rows), dtype=np.int64)
        runs: list[np.ndarray] = []
        for i, (a, b) in enumerate(zip(first, first[1:])):
            if b - a < run:
                continue
            lengths = text.end[a + run - 1 : b] - text.start[a : b - run + 1]
            need[i] = max(1, int(lengths.min()) - q + 1 - edits * q)
            self.span[i] = int(lengths.max()) + edits
            self.origin[i] = text.start[a]
            keep.append(np.arange(text.start[a], max(text.start[a], text.end[b - 1] - q + 1)))
            windows = np.lib.stride_tricks.sliding_window_view(text.hash[a:b], run)
            runs.append(np.column_stack([_fold(windows), np.full(len(windows), i, dtype=np.uint64)]))
        at = np.concatenate(keep) if keep else np.zeros(0, dtype=np.int64)
        order = np.argsort(grams[at], kind="stable")
        self.gram, self.place = grams[at][order], at[order]
        self.owner = text.row[self.place]
        self.need = need
        self.present = np.zeros(1 << 22, dtype=bool)
        self.present[(self.gram & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.runs = np.concatenate(runs) if runs else np.zeros((0, 2), dtype=np.uint64)
        self.runs = self.runs[np.argsort(self.runs[:, 0], kind="stable")]


def _step(value: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    from cairn.llm.textvec import mix64

    return mix64(value + word + np.uint64(k + 1))


def _fold(windows: np.ndarray) -> np.ndarray:
    value = np.zeros(len(windows), dtype=np.uint64)
    for k in range(windows.shape[1]):
        value = _step(value, windows[:, k], k)
    return value


def _ranges(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, all of start[i] .. start[i] + length[i] - 1; and i."""
    owner = np.repeat(np.arange(len(start)), length)
    return np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + start[owner], owner


def regions(doc: _Text, p: Passages) -> np.ndarray:
    """Retained regions: columns doc row, passage, first and last document position, band's lowest diagonal; one row per (row, passage, band)."""
    none = np.zeros((0, 5), dtype=np.int64)
    if not len(p.gram):
        return none
    grams = doc.grams(p.q)
    at = np.flatnonzero(p.present[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
    # A q-gram over the end of a row belongs to no text.
    at = at[doc.row[at] == doc.row[at + p.q - 1]]
    low = np.searchsorted(p.gram, grams[at], side="left")
    count = np.searchsorted(p.gram, grams[at], side="right") - low
    hit, owner = _ranges(low, count)
    if not len(hit):
        return none
    place, passage, position = p.place[hit], p.owner[hit], at[owner]
    row, diagonal = doc.row[position], place - position
    width = 2 * (p.edits + 1)
    out = []
    for shift in (0, p.edits + 1):
        band = (diagonal + shift) // width
        order = np.lexsort((position, band, passage, row))
        r, s, b, x = row[order], passage[order], band[order], position[order]
        # Dense enough: ``need`` hits within the span of a run.
        need = p.need[s]
        last = np.arange(len(x)) + need - 1
        fits = last < len(x)
        i, j = np.flatnonzero(fits), last[fits]
        good = (r[i] == r[j]) & (s[i] == s[j]) & (b[i] == b[j]) & (x[j] - x[i] <= p.span[s[i]] - p.q)
        if good.any():
            i, j = i[good], j[good]
            out.append(np.column_stack([r[i], s[i], x[i], x[j] + p.q, b[i] * width - shift]))
    if not out:
        return none
    found = np.concatenate(out)
    found = found[np.lexsort((found[:, 2], found[:, 4], found[:, 1], found[:, 0]))]
    head = np.ones(len(found), dtype=bool)
    head[1:] = (found[1:, [0, 1, 4]] != found[:-1, [0, 1, 4]]).any(axis=1)
    first = np.flatnonzero(head)
    merged = found[first].copy()
    merged[:, 3] = np.maximum.reduceat(found[:, 3], first)
    return merged


def banded_distances(a: np.ndarray, lengths: np.ndarray, points: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """For each i, the least number of edits that turn the whole pattern ``a[i, :lengths[i]]`` into a stretch of ``points[low[i]:high[i]]``, by an
    alignment that begins at ``start[i]`` + 0 .. width - 1 and whose diagonal stays among these ``width`` ones. One array operation per character, for all
    patterns together."""
    far, columns = 1 << 20, np.arange(width)
    place = start[:, None] + columns  # what the next pattern character is compared with
    cost = np.where((place >= low[:, None]) & (place <= high[:, None]), 0, far)
    result = np.where(lengths == 0, 0, far)
    for i in range(a.shape[1]):
        inside = (place >= low[:, None]) & (place < high[:, None])
        differs = points[np.clip(place, 0, len(points) - 1)] != a[:, i : i + 1]
        step = np.where(inside, cost + differs, far)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a character of the pattern is left out
        step = np.minimum.accumulate(step - columns, axis=1) + columns  # characters of the document are left out
        place = place + 1
        cost = np.where((place >= low[:, None]) & (place <= high[:, None]), step, far)
        done = lengths == i + 1
        result[done] = cost[done].min(axis=1)
    return result


def _leaks_of(texts: list[str | None], ids: np.ndarray, p: Passages, exact: bool) -> pa.RecordBatch:
    doc = _Text(texts)
    aligned = _aligned(doc, p, regions(doc, p))
    if exact:
        pairs = _verified(doc, p, aligned[:, [0, 1]])
        return pa.record_batch([pa.array(ids[pairs[:, 0]].astype(np.int64)), pa.array(p.items[pairs[:, 1]])], names=["doc_id", "item_id"])
    columns = [ids[aligned[:, 0]].astype(np.int64), p.items[aligned[:, 1]], aligned[:, 2], aligned[:, 3]]
    return pa.record_batch([pa.array(c) for c in columns], names=["doc_id", "item_id", "edits", "word_no"])


def _udf(p: Passages, exact: bool, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, window):
                batch = whole.slice(at, window)
                yield _leaks_of(batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False), p, exact)

    return run


def _verified(doc: _Text, p: Passages, aligned: np.ndarray) -> np.ndarray:
    """Of aligned pairs (row, passage) those in which ``run`` consecutive words are the same."""
    if not len(aligned) or len(doc.hash) < p.run:
        return np.zeros((0, 2), dtype=np.int64)
    key = np.unique(aligned[:, 0] * len(p.items) + aligned[:, 1])
    rows = np.zeros(int(doc.word_row[-1]) + 1, dtype=bool)
    rows[aligned[:, 0]] = True
    at = np.flatnonzero((doc.word_row[: len(doc.hash) - p.run + 1] == doc.word_row[p.run - 1 :]) & rows[doc.word_row[: len(doc.hash) - p.run + 1]])
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(p.run):
        value = _step(value, doc.hash[at + k], k)
    low, high = np.searchsorted(p.runs[:, 0], value, side="left"), np.searchsorted(p.runs[:, 0], value, side="right")
    hit, owner = _ranges(low, high - low)
    same = np.intersect1d(doc.word_row[at[owner]] * len(p.items) + p.runs[hit, 1].astype(np.int64), key)
    return np.column_stack([same // len(p.items), same % len(p.items)])


def _aligned(doc: _Text, p: Passages, retained: np.ndarray, block: int = 20_000) -> np.ndarray:
    """Columns doc row, passage, edits, word: the runs of words of retained pairs that lie in their region's band with few enough edits."""
    width = 2 * (p.edits + 1)
    first = np.searchsorted(p.text.word_row, np.arange(len(p.items) + 1))
    runs = np.maximum(0, np.diff(first) - p.run + 1)
    row_first = np.searchsorted(doc.row, np.arange(int(doc.row[-1]) + 2 if len(doc.row) else 1))
    # Every run that can lie in the region: its place in the document, by the band, overlaps the region.
    word, region = _ranges(first[retained[:, 1]], runs[retained[:, 1]])
    begin, end = p.text.start[word], p.text.end[np.minimum(word + p.run - 1, len(p.text.end) - 1)]
    start = begin - (retained[region, 4] + width - 1) - p.edits
    # By the q-gram lemma for this very run: so many of its q-grams must be among the region's hits, and so must the characters they span.
    least = np.maximum(1, (end - begin) - p.q + 1 - p.edits * p.q) + p.q - 1 - 2 * p.edits
    latest = start + width - 1 + 2 * p.edits
    overlap = np.minimum(latest + (end - begin), retained[region, 3]) - np.maximum(start, retained[region, 2])
    near = overlap >= least
    word, region, begin, end, start = (x[near] for x in (word, region, begin, end, start))
    edits = np.zeros(len(word), dtype=np.int64)
    for at in range(0, len(word), block):
        part = slice(at, at + block)
        lengths = end[part] - begin[part]
        pattern = np.full((len(lengths), int(lengths.max())), 0xFFFF, dtype=np.uint32)
        place, owner = _ranges(begin[part], lengths)
        pattern[owner, place - begin[part][owner]] = p.text.points[place]
        rows = retained[region[part], 0]
        edits[part] = banded_distances(pattern, lengths, doc.points, start[part], row_first[rows], row_first[rows + 1], width + 2 * p.edits)
    good = edits <= p.edits
    word, region, edits = word[good], region[good], edits[good]
    passage = retained[region, 1]
    return np.column_stack([retained[region, 0], passage, edits, word - first[passage]])


#: Bits of the bitmap of evaluation q-grams, a fixed size of 16 MB.
BITS = 1 << 27


def _grams_udf(q: int, present: np.ndarray | None, window: int = 1000):
    """(id, text) to all (gram, id); with a bitmap to the distinct ones of each batch that are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, window):
                batch = whole.slice(at, window)
                text = _Text(batch.column(1).to_pylist())
                gram = text.grams(q)
                place = np.flatnonzero(text.row[: len(gram)] == text.row[q - 1 : q - 1 + len(gram)]) if len(gram) else np.zeros(0, dtype=np.int64)
                if present is not None:
                    bit = (gram[place] & np.uint64(BITS - 1)).astype(np.int64)
                    place = place[(present[bit >> 3] >> (bit & 7)) & 1 > 0]
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                pairs = np.column_stack([gram[place].view(np.int64), text.row[place]])
                pairs = pairs if present is None else np.unique(pairs, axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(ids[pairs[:, 1]].astype(np.int64))], names=["gram", "id"])

    return run


def _by_join(source: DataFrame, passages: DataFrame, run: int, edits: int, q: int, exact: bool, schema: str) -> DataFrame:
    """For evaluation sides too large for an index: pairs by an equi-join on q-grams that both sides have, then each pair by itself."""
    named = durable(passages.withColumn("passage", F.xxhash64("item_id", "text")), "passages")
    counted = named.select("passage", "text").mapInArrow(_grams_udf(q, None), "gram bigint, id bigint").groupBy("gram", "id").agg(F.count("*").alias("times"))
    ours = durable(counted, "grams")
    words = ours.select(F.expr(f"(gram & {BITS - 1}) >> 3").alias("byte"), F.expr("1 << cast(gram & 7 as int)").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    present = np.zeros(BITS >> 3, dtype=np.uint8)
    for r in words.toLocalIterator():  # at most as many rows as the bitmap has bytes
        present[r.byte] = r.bits
    theirs = source.mapInArrow(_grams_udf(q, present), "gram bigint, id bigint").distinct()
    # The lemma's least count of shared q-grams, for the shortest run there can be (words of one character); where a passage repeats q-grams, distinct ones say less and one must do.
    least = F.when(F.col("repeats"), 1).otherwise(max(1, 2 * run - 1 - q + 1 - edits * q))
    met = theirs.join(ours.select("gram", F.col("id").alias("passage")), "gram").groupBy("id", "passage").agg(F.count("*").alias("n"))
    repeats = ours.groupBy(F.col("id").alias("passage")).agg((F.max("times") > 1).alias("repeats"))
    met = durable(met.join(repeats, "passage").where(F.col("n") >= least).select("id", "passage"), "met")
    texts = source.join(met.select("id").distinct().withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    pairs = met.withColumnRenamed("id", "doc_id").join(named.select("passage", "item_id", F.col("text").alias("said")), "passage").join(texts, "doc_id").select("doc_id", "text", "item_id", "said")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, item_id, said in zip(*(c.to_pylist() for c in batch.columns)):
                yield _leaks_of([text], np.array([doc_id]), Passages([(item_id, said)], run, edits, q), exact)

    return pairs.mapInArrow(each, schema)


def leaks(docs: DataFrame, items: DataFrame, *, exact: bool = True, run: int = 10, edits: int = 2, q: int = 12, index_chars: int = 2_000_000, window: int = 1000) -> DataFrame:
    """``docs``: (id, text); ``items``: (id, text), several rows an item allowed. Exact: (``doc_id``, ``item_id``); else also ``edits`` of the best run and
    ``word_no``, its first word within the passage."""
    spark = docs.sparkSession
    ship(spark)
    d, i = docs.columns, items.columns
    edits = 0 if exact else edits
    source = docs.select(F.col(d[0]).cast("bigint").alias("doc_id"), F.col(d[1]).alias("text")).where("doc_id is not null and text is not null")
    passages = items.select(F.col(i[0]).cast("bigint").alias("item_id"), F.col(i[1]).alias("text")).where("item_id is not null and text is not null").distinct()
    schema = "doc_id bigint, item_id bigint" + ("" if exact else ", edits bigint, word_no bigint")
    if (passages.agg(F.sum(F.length("text"))).first()[0] or 0) <= index_chars:
        rows = [(r.item_id, r.text) for r in passages.orderBy("item_id", "text").collect()]  # of a size that was just checked
        out = spread(source).mapInArrow(_udf(Passages(rows, run, edits, q), exact, window), schema)
    else:
        out = _by_join(source, passages, run, edits, q, exact, schema)
    return out.distinct() if exact else out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "word_no")).alias("best")).select("doc_id", "item_id", "best.*")
