"""Abusive, hateful and sexual content, by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a logistic score from its words and word pairs; the document's score is their noisy-or,
1 - prod(1 - p). Only document labels are known: the sentence weights are trained through the noisy-or, and the trained sentence scores then say which
sentences offend.

Before words are taken, spelling tricks are undone: compatibility forms and case, zero-width characters, look-alike letters of other scripts, digits and
signs within words, letters stretched to three or more, single letters set apart by spaces or dots. Nothing is a word list: all weights come from the labels.

Training runs on the driver over at most ``max_train_docs`` labelled documents and ``max_train_chars`` of their characters, the first ones by a hash of their id (a documented bound: 8,000 documents
and 40 million characters); everything else, scores, rates and located sentences, covers all documents in one pass without a shuffle of texts. The weights, whose size is
fixed (``buckets`` floats a model), travel with the function.

Labels are noisy. Three folds give every training document a score by a model that has not seen it. From these the rates of wrong labels of both kinds and the threshold with the best F1 (against labels corrected
for those rates) are estimated, and the last model, which scores all documents, is trained under these rates. ``heldout`` reports the out-of-fold quality; ``out_of_fold`` scores training documents
by the model that hasn't seen them, so that no document is judged by its own label.

Defined cases: null ids are ignored, a repeated id counts once; null, empty and blank texts score 0; labels of null value are ignored, raters who disagree give a
label between 0 and 1; without labels of both kinds no model can be trained and every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.durable import durable
from cairn.session import ship, spread

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухікмнтвгзѕјԁԛѡӏαοεικνρτυχ", "aeopcyxikmhtbrzsjdqwlaoeiknptyx"))
#: Digits and signs that stand for letters within a word.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_BREAK = 0xFFFF
_NUMBER = np.uint64(0x5851F42D4C957F2D)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code point to code point (0: left out), is it a letter, letter for a sign (0: none)."""
    to = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x3000):
        low = chr(c).lower()
        if len(low) == 1:
            to[c] = ord(low)
        if unicodedata.category(chr(c)) == "Cf":
            to[c] = 0
    for a, b in LOOKALIKES.items():
        to[ord(a)] = ord(b)
        if len(a.upper()) == 1:
            to[ord(a.upper())] = ord(b)
    to[0xFEFF] = to[0xFE0F] = 0
    letter = np.zeros(0x110000, dtype=bool)
    letter[:0x3100] = [chr(c).isalpha() for c in range(0x3100)]
    sign = np.zeros(0x110000, dtype=np.uint32)
    for a, b in SIGNS.items():
        sign[ord(a)] = ord(b)
    return to, letter, sign


class Sentences:
    """Sentences of a batch: ``row`` of each, and of each feature its ``sentence`` and ``bucket``; ``raw`` has each sentence's span in the normalised text."""

    def __init__(self, texts: list[str | None], buckets: int):
        from cairn.llm.textvec import Words, mix64, word_table

        to, letter, sign = _tables()
        whole = "￿".join("" if t is None else t.replace("￿", " ") for t in texts)
        if not whole.isascii():
            whole = unicodedata.normalize("NFKC", whole)
        self.text = whole
        raw = np.frombuffer(whole.encode("utf-32-le", "replace"), dtype=np.uint32)
        place = np.arange(len(raw))
        x = to[raw]
        keep = x != 0
        x, place = x[keep], place[keep]
        x, place = self._single_letters(x, place)
        # Signs beside letters; a star between letters stays part of the word as it is.
        is_letter = letter[x]
        before, after = np.roll(is_letter, 1), np.roll(is_letter, -1)
        stands = (sign[x] > 0) & before & after | (sign[x] > 0) & (x != 33) & (before | after)
        x = np.where(stands, sign[x], x)
        star = (x == 42) & before & after
        x = np.where(star, np.uint32(ord("x")), x)
        # Stretched letters.
        same = np.zeros(len(x), dtype=bool)
        same[1:] = (x[1:] == x[:-1]) & letter[x[1:]]
        begin = np.flatnonzero(~same)
        length = np.diff(np.append(begin, len(x)))
        drop = same & np.repeat(length >= 3, length)
        x, place = x[~drop], place[~drop]

        offsets = np.flatnonzero(x == _BREAK)
        offsets = np.concatenate([[0], offsets + 1, [len(x)]]) if len(x) else np.zeros(len(texts) + 1, dtype=np.int64)
        ends = self._ends(x, letter)
        words = Words(x, offsets)
        self.rows = len(texts)
        edge = np.flatnonzero(ends)
        count = np.searchsorted(edge, words.start, side="left")  # sentence ends before each word
        label = count.astype(np.int64) + words.row.astype(np.int64)
        new = np.ones(len(label), dtype=bool)
        new[1:] = (label[1:] != label[:-1]) | (words.row[1:] != words.row[:-1])
        sentence = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.row = words.row[first] if len(first) else np.zeros(0, dtype=np.int64)
        last = np.append(first[1:], len(label)) - 1
        self.span = np.column_stack([place[words.start[first]], place[words.end[last] - 1] + 1]) if len(first) else np.zeros((0, 2), dtype=np.int64)
        table = word_table()
        digits = np.array([0x30 <= c <= 0x39 for c in range(128)])
        head = x[words.start] if len(words.start) else np.zeros(0, dtype=np.uint32)
        numeric = (head < 128) & digits[np.minimum(head, 127)]
        h = np.where(numeric, _NUMBER, words.hash)
        pair = np.flatnonzero(~new[1:]) if len(h) > 1 else np.zeros(0, dtype=np.int64)
        bigram = mix64(h[pair] * np.uint64(3) + mix64(h[pair + 1]))
        skip = pair[:-1][np.diff(pair) == 1] if len(pair) > 1 else pair[:0]
        trigram = mix64(h[skip] * np.uint64(5) + mix64(h[skip + 2] + np.uint64(9)))
        sentence_of = np.concatenate([sentence, sentence[pair], sentence[skip]])
        value = np.concatenate([h, bigram, trigram])
        order = np.argsort(sentence_of, kind="stable")
        self.sentence = sentence_of[order]
        self.bucket = (value[order] & np.uint64(buckets - 1)).astype(np.int64)
        self.first = np.searchsorted(self.sentence, np.arange(len(self.row)))
        del table

    @staticmethod
    def _single_letters(x: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three or more single letters, each one separator from the next, become one word."""
        from cairn.llm.textvec import word_table

        inside = word_table()[x]
        alone = inside.copy()
        alone[1:] &= ~inside[:-1]
        alone[:-1] &= ~inside[1:]
        linked = np.zeros(len(x), dtype=bool)  # a separator between two single letters
        between = np.isin(x, np.array([32, 45, 46, 95, 42, 183], dtype=np.uint32))
        linked[1:-1] = between[1:-1] & alone[:-2] & alone[2:]
        # At least two separators in a row of single letters.
        two = np.zeros(len(x), dtype=bool)
        two[2:] |= linked[2:] & linked[:-2]
        two[:-2] |= linked[:-2] & linked[2:]
        return x[~two], place[~two]

    @staticmethod
    def _ends(x: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Positions at which a sentence ends: a stop before white space, a text's end, an empty line, or the end of a line that isn't just wrapped."""
        ends = x == _BREAK
        white = (x == 32) | (x == 10) | (x == 9) | (x == 13)
        follows = np.ones(len(x), dtype=bool)
        follows[:-1] = white[1:] | ends[1:] | np.isin(x[1:], np.array([34, 39, 41, 60], dtype=np.uint32))
        ends = ends | (np.isin(x, np.array([33, 46, 63, 0x2026], dtype=np.uint32)) & follows)
        line = np.flatnonzero((x == 10) | (x == _BREAK))
        if len(line):
            length = np.diff(np.concatenate([[-1], line]))
            nxt = np.minimum(line + 1, len(x) - 1)
            wrapped = (length >= 56) & letter[x[nxt]] & (x[line] == 10)
            ends[line[~wrapped]] = True
        return ends

    def scores(self, model: "Model") -> np.ndarray:
        """The logistic score of each sentence: the mean-free sum of its features' weights, damped by length."""
        if not len(self.row):
            return np.zeros(0)
        total = np.add.reduceat(model.weights[self.bucket], self.first)
        n = np.diff(np.append(self.first, len(self.bucket)))
        return 1 / (1 + np.exp(-np.clip(model.bias + total * n ** -model.power, -30, 30)))

    def noisy_or(self, p: np.ndarray) -> np.ndarray:
        """The score of each row."""
        return 1 - np.exp(np.bincount(self.row, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=self.rows))


class Model:
    def __init__(self, weights: np.ndarray, bias: float, threshold: float, power: float = 0.5):
        self.weights, self.bias, self.threshold, self.power = weights, bias, threshold, power


def poisson_tail(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The probability of ``k`` or more where ``mean`` are expected."""
    term, below = np.exp(-mean), np.zeros(len(mean))
    for i in range(int(k.max(initial=0))):
        below += np.where(i < k, term, 0.0)
        term = term * mean / (i + 1)
    return np.clip(1 - below, 0.0, 1.0)


class _Bags:
    """The features of a set of documents: a bucket each, sentence after sentence; ``size`` features a sentence, ``bag`` its document."""

    def __init__(self, bucket: np.ndarray, bag: np.ndarray, size: np.ndarray, docs: int):
        self.bucket, self.bag, self.size, self.docs = bucket, bag, size, docs

    @classmethod
    def of(cls, texts: list[str], buckets: int) -> "_Bags":
        # The features of a thousand documents at a time; only their numbers are kept.
        parts, bags, sizes = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
        for at in range(0, len(texts), 1000):
            s = Sentences(texts[at : at + 1000], buckets)
            parts.append(s.bucket.astype(np.int32))
            bags.append((s.row + at).astype(np.int32))
            sizes.append(np.diff(np.append(s.first, len(s.bucket))).astype(np.int32))
        return cls(np.concatenate(parts), np.concatenate(bags), np.concatenate(sizes), len(texts))

    def only(self, docs: np.ndarray) -> "_Bags":
        """Those of some documents, numbered anew."""
        number = np.full(self.docs, -1, dtype=np.int32)
        number[docs] = np.arange(len(docs), dtype=np.int32)
        keep = number[self.bag] >= 0
        return _Bags(self.bucket[np.repeat(keep, self.size)], number[self.bag[keep]], self.size[keep], len(docs))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (bucket, document)."""
        pairs = np.unique(self.bucket * np.int64(self.docs) + np.repeat(self.bag, self.size))
        return pairs // self.docs, pairs % self.docs

    def scores(self, model: Model) -> np.ndarray:
        """The noisy-or of each document."""
        first = np.concatenate([[0], np.cumsum(self.size[:-1], dtype=np.int64)]) if len(self.size) else np.zeros(0, dtype=np.int64)
        total = np.add.reduceat(model.weights[self.bucket], first) if len(first) else np.zeros(0)
        p = 1 / (1 + np.exp(-np.clip(model.bias + total * self.size.astype(float) ** -model.power, -30, 30)))
        return 1 - np.exp(np.bincount(self.bag, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=self.docs))


def fit(bags: _Bags, labels: np.ndarray, *, buckets: int, counts: np.ndarray | None = None, corpus_size: int = 0, rounds: int = 120, rate: float = 0.5, decay: float = 1e-5, threshold: float = 0.2, wrong_0: float = 0.05, wrong_1: float = 0.03, least: int = 2, power: float = 0.35, bias: float = -5.0, lift: float = 6.0, chance: float = 1e-3) -> Model:
    """Weights by Adam on the documents' log loss through the noisy-or. Labels within [0, 1], some of them wrong: an offending
    document is labelled 0 with probability ``wrong_0``, another one 1 with ``wrong_1``, so no single label can force its document's sentences.
    Features of fewer than ``least`` documents (numbers, invented names) tell nothing about others and get no weight. Only features that at least ``least`` offending documents have may speak
    for an offence, and, given the whole corpus's document ``counts`` of buckets and its size, only those that offending documents have at least ``lift`` times as often as the corpus, and so often by ``chance`` at most.
    ``bias`` is not trained: a sentence that nothing speaks against scores less than one per cent, so that wrong labels cannot raise what is common to all."""
    weights = np.zeros(buckets)
    if not bags.docs or not len(bags.bucket) or labels.min() > 0.5 or labels.max() < 0.5:
        return Model(weights, -40.0, threshold)
    bag, n = bags.bag, bags.size
    first = np.concatenate([[0], np.cumsum(n[:-1], dtype=np.int64)])
    used, bucket = np.unique(bags.bucket, return_inverse=True)
    bucket = bucket.astype(np.int32)
    w = np.zeros(len(used))
    scale = n.astype(float) ** -power
    y, share = labels, 1 - wrong_0 - wrong_1
    has, doc_of = bags.pairs()
    has = np.searchsorted(used, has)
    shared = np.bincount(has, minlength=len(used)) >= least
    positive = np.bincount(has[(labels > 0.5)[doc_of]], minlength=len(used))
    speaks = positive >= least
    if counts is not None and speaks.any():
        expected = (labels > 0.5).sum() * counts[used[speaks]] / max(1, corpus_size)
        # Where offences are common no feature can be much oftener among them: the lift asked for stays below three quarters of what is possible if the corpus were like the labelled documents.
        asked = min(lift, 0.75 / (labels > 0.5).mean())
        speaks[speaks] = (positive[speaks] >= asked * expected) & (poisson_tail(positive[speaks], expected) <= chance)
    ceiling = np.where(speaks, np.inf, 0.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.clip(bias + np.add.reduceat(w[bucket], first) * scale, -30, 30)
        p = 1 / (1 + np.exp(-z))
        doc = np.clip(1 - np.exp(np.bincount(bag, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=bags.docs)), 1e-6, 1 - 1e-6)
        # The label is 1 with probability q = wrong_1 + (1 - wrong_0 - wrong_1) P; then d loss / d z = share p (1 - P) (q - y) / (q (1 - q)).
        q = wrong_1 + share * doc
        g = share * p * ((1 - doc) * (q - y) / (q * (1 - q)))[bag]
        gw = np.bincount(bucket, weights=np.repeat(g * scale, n), minlength=len(used)) / bags.docs + decay * w
        gw *= shared
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        a, b = 1 - 0.9**t, 1 - 0.99**t
        step = rate * (1 - t / (rounds + 1))
        w = np.minimum(w - step * (m / a) / (np.sqrt(v / b) + 1e-6), ceiling)
    weights[used] = w
    return Model(weights.astype(np.float32), float(bias), threshold, power)


def noise_rates(score: np.ndarray, labels: np.ndarray, default: tuple[float, float]) -> tuple[float, float]:
    """(offending documents labelled 0, others labelled 1), taken where out-of-fold scores are sure; with fewer than 30 sure documents of a kind the default counts as 30 more."""
    out = []
    for sure, wrong, prior in ((score > 0.9, labels < 0.5, default[0]), (score < 0.02, labels > 0.5, default[1])):
        out.append(float(np.clip(((sure & wrong).sum() + 30 * prior) / (sure.sum() + 30), 0.005, 0.25)))
    return out[0], out[1]


def best_threshold(score: np.ndarray, labels: np.ndarray, noise: tuple[float, float]) -> tuple[float, float, float]:
    """(threshold, recall, precision) of the best F1 against what the labels would be without noise: of n documents with k labels of 1, (k - wrong_1 n) / (1 - wrong_0 - wrong_1) offend."""
    wrong_0, wrong_1 = noise
    true = lambda mask: max(0.0, ((labels > 0.5)[mask].sum() - wrong_1 * mask.sum()) / (1 - wrong_0 - wrong_1))
    whole, best = true(np.ones(len(labels), dtype=bool)), (0.2, 0.0, 0.0)
    for t in (0.2, 0.1, 0.15, 0.25, 0.3, 0.4, 0.5):
        flagged = score >= t
        hits = min(true(flagged), flagged.sum(), whole)
        recall, precision = hits / whole if whole else 0.0, hits / flagged.sum() if flagged.any() else 0.0
        f1 = lambda r, p: 2 * r * p / (r + p) if r + p else 0.0
        if f1(recall, precision) > f1(best[1], best[2]) + 0.005:  # the first stands unless another is clearly better
            best = (t, recall, precision)
    return best


def document_counts(docs: DataFrame, buckets: int, wanted: np.ndarray, window: int = 1000) -> tuple[np.ndarray, int]:
    """In how many of all documents does each of the wanted buckets (few: those of a bounded training set) occur; and the number of documents."""
    place = np.full(buckets, -1, dtype=np.int32)
    place[wanted] = np.arange(len(wanted), dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(wanted), dtype=np.int64), 0
        for whole in batches:
            for at in range(0, whole.num_rows, window):
                s = Sentences(whole.slice(at, window).column(0).to_pylist(), buckets)
                of = place[s.bucket]
                known = of >= 0
                pairs = np.unique(s.row[s.sentence[known]] * np.int64(len(wanted)) + of[known])
                total += np.bincount(pairs % len(wanted), minlength=len(wanted))
                seen += s.rows
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(total[at], seen))], names=["k", "n"])

    found = docs.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # one row a wanted bucket and one for the size
    counts = np.zeros(len(wanted), dtype=np.int64)
    inside = found.k.to_numpy() >= 0
    counts[found.k.to_numpy()[inside]] = found.n.to_numpy()[inside]
    return counts, int(found.n.to_numpy()[~inside].sum())


class Trained:
    """The model of all training documents, and of each fold the model that hasn't seen it; ``fold`` gives a training document's fold, ``heldout`` their out-of-fold scores and labels."""

    def __init__(self, model: Model, folds: list[Model], fold: dict[int, int], heldout: dict):
        self.model, self.folds, self.fold, self.heldout, self.threshold = model, folds, fold, heldout, model.threshold

    def alone(self) -> "Trained":
        """Without the folds, so that only one model travels with the scoring function."""
        return Trained(self.model, [], {}, self.heldout)


def train(docs: DataFrame, labels: DataFrame, *, max_train_docs: int = 8000, max_train_chars: int = 40_000_000, buckets: int = 1 << 18, folds: int = 3, **options) -> Trained:
    """``docs``: (id, text); ``labels``: (id, 0/1). A document's label is the mean of its raters'. The corpus's counts are over all of ``docs``."""
    ship(docs.sparkSession)
    d, n = docs.columns, labels.columns
    voted = labels.select(F.col(n[0]).cast("bigint").alias("id"), F.col(n[1]).cast("double").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.avg("y").alias("y"))
    # The bounds hold before any text is moved to the driver: first of documents, then, by their lengths, of characters.
    chosen = voted.orderBy(F.xxhash64("id"), "id").limit(max_train_docs)
    texts = docs.select(F.col(d[0]).cast("bigint").alias("id"), F.col(d[1]).alias("text")).where("id is not null and text is not null")
    labelled = durable(texts.join(chosen, "id").groupBy("id").agg(F.max("text").alias("text"), F.first("y").alias("y")).withColumn("turn", F.xxhash64("id")), "labelled")
    lengths = labelled.select("id", "turn", F.length("text").alias("n")).orderBy("turn", "id").toPandas()
    within = lengths.n.cumsum() <= max_train_chars
    kept = labelled if within.all() else labelled.where(F.col("turn") < int(lengths.turn[~within].iloc[0]))
    rows = kept.orderBy("id").toPandas()
    y = rows.y.to_numpy(dtype=float)
    bags = _Bags.of(rows.text.tolist(), buckets)
    # One pass over the corpus counts every bucket that any of the models may ask for.
    has, doc_of = bags.pairs() if bags.docs else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    often = np.flatnonzero(np.bincount(has[(y > 0.5)[doc_of]], minlength=buckets) >= options.get("least", 2)) if len(has) else np.zeros(0, dtype=np.int64)
    counts, size = np.zeros(buckets, dtype=np.int64), 0
    if len(often):
        counts[often], size = document_counts(spread(texts.select("text")), buckets, often)
    same = {"buckets": buckets, "counts": counts, "corpus_size": size, **options}
    fold = (rows.turn.to_numpy(dtype=np.int64) % folds) if len(rows) else np.zeros(0, dtype=np.int64)
    out_of_fold = np.zeros(len(y))
    models = []
    for f in range(folds):
        models.append(fit(bags.only(np.flatnonzero(fold != f)), y[fold != f], **same))
        inside = np.flatnonzero(fold == f)
        if len(inside):
            out_of_fold[inside] = bags.only(inside).scores(models[-1])
    noise = noise_rates(out_of_fold, y, (options.get("wrong_0", 0.05), options.get("wrong_1", 0.03)))
    threshold, recall, precision = best_threshold(out_of_fold, y, noise) if len(y) else (0.2, 0.0, 0.0)
    same |= {"wrong_0": noise[0], "wrong_1": noise[1], "threshold": threshold}
    report = {"n_docs": len(y), "n_positive": int((y > 0.5).sum()), "wrong_0": noise[0], "wrong_1": noise[1], "threshold": threshold, "recall": recall, "precision": precision, "n_flagged": int((out_of_fold >= threshold).sum()), "n_flagged_positive": int(((out_of_fold >= threshold) & (y > 0.5)).sum())}
    return Trained(fit(bags, y, **same), models, dict(zip(rows.id.tolist(), fold.tolist())), report)


def _udf(trained: Trained, located: bool, window: int, out_of_fold: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained.model
        for whole in batches:
            for at in range(0, whole.num_rows, window):
                batch = whole.slice(at, window)
                ids = batch.column(0)
                s = Sentences(batch.column(1).to_pylist(), len(model.weights))
                p = s.scores(model)
                if out_of_fold:
                    fold = np.array([trained.fold.get(i, -1) for i in ids.to_pylist()], dtype=np.int64)
                    for f, other in enumerate(trained.folds):
                        of = fold[s.row] == f
                        p[of] = s.scores(other)[of]
                if not located:
                    yield pa.record_batch([ids, pa.array(s.noisy_or(p)), pa.array(np.bincount(s.row[p >= model.threshold], minlength=s.rows))], names=["id", "score", "n_sentences"])
                    continue
                hit = np.flatnonzero(p >= model.threshold)
                number = np.arange(len(s.row)) - np.searchsorted(s.row, s.row)
                text = [s.text[a:b] for a, b in s.span[hit].tolist()]
                yield pa.record_batch([ids.take(pa.array(s.row[hit])), pa.array(number[hit]), pa.array(text, pa.string()), pa.array(p[hit])], names=["id", "sentence_no", "sentence", "score"])

    return run


def score(docs: DataFrame, model: Trained, window: int = 1000, out_of_fold: bool = False) -> DataFrame:
    """(``id``, ``score``, ``n_sentences`` that alone reach the threshold): one row per delivered document."""
    ship(docs.sparkSession)
    d = docs.columns
    model = model if out_of_fold else model.alone()
    return spread(docs.select(F.col(d[0]).cast("bigint").alias("id"), F.col(d[1]).alias("text"))).where("id is not null").mapInArrow(_udf(model, False, window, out_of_fold), "id bigint, score double, n_sentences bigint")


def locate(docs: DataFrame, model: Trained, window: int = 1000) -> DataFrame:
    """(``id``, ``sentence_no`` from 0, ``sentence``, ``score``): the offending sentences, in the documents' normalised text."""
    ship(docs.sparkSession)
    d = docs.columns
    rows = docs.select(F.col(d[0]).cast("bigint").alias("id"), F.col(d[1]).alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(_udf(model.alone(), True, window), "id bigint, sentence_no bigint, sentence string, score double").distinct()
