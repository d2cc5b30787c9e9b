"""Column expressions over URLs and hosts; malformed ones give null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import fixed_values as V


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def clean_url(url: Column) -> Column:
    """Scheme, host and path without a trailing slash; null for anything but a web page, a link wrapped in a path or a credential in one."""
    protocol, path = F.try_parse_url(url, F.lit("PROTOCOL")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    bad = path.rlike(r"(?i)https?(?::|%3a)(?:/|%2f){2}") | path.rlike(r"(?i)(?:/|%26|;)(?:token|access_token|sig|code|secret|password|key)=")
    return F.when(protocol.isin("http", "https") & host(url).isNotNull() & ~bad, F.regexp_replace(F.concat(protocol, F.lit("://"), host(url), path), "/+$", ""))


def is_local(h: Column) -> Column:
    """This machine, a private network, or a name that only resolves inside one."""
    private = h.rlike(r"^(?:10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|\[?::1\]?$|\[?f[cd])")
    suffix = F.lit(False)
    for s in V.LOCAL_SUFFIXES:
        suffix = suffix | F.endswith(h, F.lit(s))
    return F.coalesce((h == "") | (h == "localhost") | (~h.contains(".") & ~h.contains(":")) | suffix | private, F.lit(True))


def is_sign_in(h: Column) -> Column:
    labels = F.split(h, r"\.")
    front = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(1)))
    named = F.exists(front, lambda x: x.isin(*V.SIGN_IN_LABELS) | x.rlike("^(?:" + "|".join(V.SIGN_IN_PREFIXES) + ")"))
    return named | ((F.element_at(labels, 1) == "id") & (F.size(labels) > 2))


def suffixes(h: Column) -> Column:
    """A host and all its parent domains."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def allowed(pages: DataFrame, url_col: str, denied: DataFrame, domain_col: str) -> DataFrame:
    """Pages that may be read: web pages, not local, not for signing in, not under a denied domain (which covers its subdomains)."""
    h = host(F.col(url_col))
    candidates = pages.where(clean_url(F.col(url_col)).isNotNull() & ~is_local(h) & ~is_sign_in(h)).withColumn("_host", h)
    hosts = candidates.select("_host").distinct().withColumn("_domain", F.explode(suffixes(F.col("_host"))))
    stopped = hosts.join(denied.select(F.lower(F.col(domain_col)).alias("_domain")), "_domain", "left_semi").select("_host").distinct()
    return candidates.join(stopped, "_host", "left_anti").drop("_host")
