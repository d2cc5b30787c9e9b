"""Vectors and stems that SQL expressions can't give: Arrow-batched functions."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[a-z0-9][a-z0-9_.+-]*")


def features(text: str) -> Counter:
    """Words (``w:``), their four-letter windows (``c:``) and pairs of neighbours (``b:``), with their counts."""
    words = _WORD.findall(text.lower())
    found = Counter(f"w:{w}" for w in words)
    found.update(f"c:{w[i : i + 4]}" for w in words for i in range(len(w) - 3))
    found.update(f"b:{a}_{b}" for a, b in zip(words, words[1:]))
    return found


def place(feature: str, dims: int) -> tuple[int, float]:
    """A feature's coordinate and sign: its BLAKE2b digest of eight bytes, big-endian, modulo the dimensions; minus unless the highest bit is set."""
    h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
    return h % dims, 1.0 if h >> 63 else -1.0


def hash_vectors(texts: list[str], dims: int = 384) -> np.ndarray:
    """Signed feature hashing, counts damped by 1 + ln(count), of unit length; a text without words is a zero vector. Each distinct feature of the batch is hashed once."""
    counted = [features(t) for t in texts]
    names: dict[str, int] = {}
    at = np.fromiter((names.setdefault(f, len(names)) for c in counted for f in c), dtype=np.int64)
    n = np.fromiter((v for c in counted for v in c.values()), dtype=np.float64)
    row = np.repeat(np.arange(len(texts)), [len(c) for c in counted])
    out = np.zeros((len(texts), dims))
    if len(at):
        where, sign = (np.array(x) for x in zip(*(place(f, dims) for f in names)))
        np.add.at(out, (row, where[at]), sign[at] * (1 + np.log(n)))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


def hash_vector(text: str, dims: int = 384) -> np.ndarray:
    return hash_vectors([text], dims)[0]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    vectors = hash_vectors([t or "" for t in texts])
    return pd.Series([None if t is None else v for t, v in zip(texts, vectors)])


def _measure(stem: str) -> int:
    """Vowel-consonant sequences of a stem."""
    form = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall("v+c+", form))


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or word[i] == "y" and i > 0 and not _vowel(word, i - 1)


def _short(word: str) -> bool:
    n = len(word)
    return n >= 3 and not _vowel(word, n - 1) and _vowel(word, n - 2) and not _vowel(word, n - 3) and word[-1] not in "wxy"


#: Suffix rules of Porter's algorithm, steps 2 to 4.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def porter(word: str) -> str:
    """The stem of an English word by Porter's published algorithm; diacritics are taken off first."""
    w = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            stem = w[: -len(end)]
            if w.endswith(end) and any(_vowel(stem, i) for i in range(len(stem))):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and any(_vowel(w, i) for i in range(len(w) - 1)):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        pairs = [r.split(":") for r in rules.split()]
        for end, to in sorted(pairs, key=lambda p: -len(p[0])):
            if w.endswith(end):
                w = w[: -len(end)] + to if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(STEP_4.split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short(stem):
            w = stem
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    """For distinct terms, not for running text."""
    return words.map(lambda w: None if w is None else porter(w))
