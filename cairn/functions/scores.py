"""Column expressions for weights, similarities and decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import fixed_values as V


def idf(total: Column, frequency: Column) -> Column:
    """Rarity of a term; one never seen weighs most."""
    return F.ln(1.0 + (total - frequency + 0.5) / (frequency + 0.5))


def term_weight(total: Column, frequency: Column) -> Column:
    """Rarity, with unseen terms held down; null for terms so common that they say nothing."""
    common = (total >= V.COMMON_MIN_CORPUS) & (frequency / total > V.COMMON_SHARE)
    return F.when(~common, F.when(frequency == 0, V.MISSING_TERM * idf(total, F.lit(1))).otherwise(idf(total, frequency)))


def bm25(tf: Column, df: Column, length: Column, total: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """One term's part of a BM25 score."""
    return idf(total, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Within [-1, 1]; 0 for a null, zero or non-finite vector; vectors of different length are compared over the common part."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    c = dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))
    return F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def age_days(at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400e6))


def recency(at: Column, now: Column, half_life: float = V.HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), age_days(at, now) / half_life)


def periods(confirmed: Column, now: Column, ttl_days: Column) -> Column:
    """Whole times-to-live since the last confirmation."""
    return F.when(ttl_days > 0, F.floor(age_days(confirmed, now) / ttl_days)).otherwise(0)


def decay(elapsed: Column) -> Column:
    return F.when(elapsed <= 0, 1.0).when(elapsed == 1, 0.8).when(elapsed == 2, 0.5).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Null if both sets are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def fingerprint_similarity(parts: list[tuple[float, Column, Column]], least_evidence: float = 0.5) -> Column:
    """Weighted overlap of (weight, set, set); sets that are empty on both sides don't count, thin evidence is held down."""
    overlaps = [(w, jaccard(a, b)) for w, a, b in parts]
    weight = sum((F.when(o.isNotNull(), w).otherwise(0.0) for w, o in overlaps), F.lit(0.0))
    value = sum((F.coalesce(o, F.lit(0.0)) * w for w, o in overlaps), F.lit(0.0))
    return F.when(weight > 0, value / F.greatest(weight, F.lit(least_evidence))).otherwise(0.0)


def rank_score(confidence: Column, relevance: Column, recency_: Column, similarity: Column, cross_project: Column, named: Column, boost: float = 1.45) -> Column:
    """Whether it answers and whether it is trusted, times freshness, likeness of the projects and bonuses."""
    total = confidence * relevance * recency_ * (0.45 + 0.6 * similarity) * F.when(cross_project, boost).otherwise(1.0)
    return F.round(total * F.when(named, 1.15).otherwise(1.0), 6)
