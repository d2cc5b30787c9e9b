"""Column expressions over text. All stay in the JVM; a null text gives a null or an empty array, as stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import fixed_values as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record_tokens(c: Column | str) -> Column:
    """Lower-case tokens that keep names like ``scikit-learn`` whole; repeated tokens stay."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([a-z0-9][a-z0-9_.+-]*)"), 1)


def entity_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([a-z0-9][a-z0-9_.+#-]*)"), 1)


def pieces(c: Column | str) -> Column:
    """The pieces of all words in their own case, in order, empty ones dropped."""
    words = F.regexp_extract_all(_col(c), F.lit(r"(?U)([^\W_][\w\-+.#]*)"), 1)
    return F.filter(F.flatten(F.transform(words, lambda w: F.split(w, r"[\-_.+#]+"))), lambda p: p != "")


def vocabulary(c: Column | str) -> Column:
    """Distinct lower-case pieces in order of first occurrence."""
    return F.array_distinct(F.transform(pieces(c), F.lower))


def question_terms(c: Column | str) -> Column:
    """Distinct topical words of a question in order: no stop words, nothing shorter than two characters, two only with a digit or in capitals."""
    stop = F.array(*(F.lit(w) for w in V.STOP_WORDS))
    capitals = lambda p: (F.upper(p) == p) & (F.lower(p) != p)
    kept = F.filter(pieces(c), lambda p: ~F.array_contains(stop, F.lower(p)) & (F.length(p) >= 2) & ((F.length(p) > 2) | p.rlike(r"\d") | capitals(p)))
    return F.array_distinct(F.transform(kept, F.lower))


def name_terms(c: Column | str) -> Column:
    """The words of a project's key or a title, two characters and more, distinct."""
    return F.array_distinct(F.filter(F.split(F.lower(_col(c)), r"(?U)[\W_]+"), lambda p: F.length(p) >= 2))


def search_terms(c: Column | str) -> Column:
    return name_terms(c)


def close(a: Column, b: Column) -> Column:
    """Are two words the same word in different inflections?"""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n, gap = F.length(short), F.length(long) - F.length(short)
    ending = F.substring(long, n + 1, F.lit(64)).isin("", *V.INFLECTIONS) & F.startswith(long, short)
    stem = (n >= 6) & (gap <= 4) & (F.substring(a, F.lit(1), n - 1) == F.substring(b, F.lit(1), n - 1))
    return (n >= 4) & (ending | stem)


def contains_term(words: Column, term: Column) -> Column:
    """Has a vocabulary this term in any inflection?"""
    inflected = F.exists(words, lambda w: (F.substring(w, 1, 1) == F.substring(term, 1, 1)) & close(term, w))
    return F.array_contains(words, term) | ((F.length(term) >= 4) & inflected)


def token_estimate(c: Column | str) -> Column:
    """About how many model tokens a text takes: by characters or by words, whichever says more; 0 for an empty one."""
    x = _col(c)
    n = F.ceil(F.greatest(F.length(x) / F.lit(3.6), F.regexp_count(x, F.lit(r"\S+")) * F.lit(1.35)))
    return F.when(F.length(x) == 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), n))


def prompt_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(_col(c))), 256), 1, 16)


def content_hash(*columns: Column | str) -> Column:
    """The natural key of a record: the first 32 hexadecimal digits of SHA-256 over the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns)), 256), 1, 32)


def slug(c: Column | str) -> Column:
    x = F.trim(F.regexp_replace(F.lower(_col(c)), r"(?U)[^\p{Alnum}]+", "-"))
    return F.coalesce(F.nullif(F.regexp_replace(x, r"^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def clean_set(c: Column | str) -> Column:
    """Trimmed, lower-cased, sorted, distinct, without empty strings or nulls."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(_col(c), lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull() & (v != ""))))


def normal_entity(c: Column) -> Column:
    """Without surrounding punctuation, lower-cased, under its usual name."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"""^[.,;:!?()\[\]{}"'`]+|[.,;:!?()\[\]{}"'`]+$""", "")
    names = F.create_map(*(F.lit(x) for pair in V.ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, bare), bare)


def candidate_terms(c: Column | str) -> Column:
    """Everything a prompt might name: tokens, their hyphen and underscore forms, singulars, and pairs of neighbours joined by a space, hyphen or underscore."""
    t = entity_tokens(c)
    forms = F.flatten(F.transform(t, lambda w: F.array(w, F.replace(w, F.lit("_"), F.lit("-")), F.replace(w, F.lit("-"), F.lit("_")), F.rtrim(w, F.lit("s")))))
    after = F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))
    pairs = lambda sep: F.filter(F.zip_with(t, after, lambda a, b: F.concat(a, F.lit(sep), b)), lambda p: p.isNotNull())
    return F.array_distinct(F.concat(forms, pairs(" "), pairs("-"), pairs("_")))


def title_of(c: Column | str) -> Column:
    """The first line that is not blank, without heading marks."""
    first = F.regexp_extract(_col(c), r"(?s)^\s*([^\n]*)", 1)
    return F.trim(F.regexp_replace(first, r"^#{1,6}\s+|\r", ""))
