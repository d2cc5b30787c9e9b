"""Commit logs, browser visits and session files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field and record separators of a commit log written with ``git log --format=%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%D%x1f%s%x1f%b%x1e``.
FIELD, RECORD = "\x1f", "\x1e"


def commits(spark: SparkSession, path: str, authors: DataFrame | None = None, since: str | None = None) -> DataFrame:
    """(sha, parents, author_name, author_email, authored_at, refs, subject, body): a commit log dump, records and fields split by control characters."""
    raw = spark.read.option("lineSep", RECORD).text(path).where(F.col("value").rlike(r"\S"))
    f = F.split(F.regexp_replace("value", "^\\s+", ""), FIELD)
    part = lambda i: F.get(f, F.lit(i))
    c = raw.select(part(0).alias("sha"), F.filter(F.split(part(1), " "), lambda x: x != "").alias("parents"), part(2).alias("author_name"), F.lower(part(3)).alias("author_email"), F.try_to_timestamp(part(4)).alias("authored_at"), part(5).alias("refs"), F.trim(part(6)).alias("subject"), F.trim(part(7)).alias("body"))
    if since:
        c = c.where(F.col("authored_at") >= F.lit(since).cast("timestamp"))
    return c.join(authors.select(F.lower("email").alias("author_email")).distinct(), "author_email", "left_semi") if authors is not None else c


def author_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy(F.lower("author_email").alias("author_email")).agg(F.count("*").alias("n"))


def chromium_time(micros: Column) -> Column:
    """Microseconds since 1601-01-01."""
    return F.timestamp_micros(micros - F.lit(11_644_473_600_000_000))


def pages(visits: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, title, n_visits, first_at, last_at): visits joined with addresses; the latest non-empty title of each."""
    v = visits.join(urls.select(F.col("id").alias("url_id"), F.col("url").alias("address"), "title"), visits["url"] == F.col("url_id")).withColumn("at", chromium_time(F.col("visit_time")))
    return v.groupBy(F.col("address").alias("url")).agg(F.max_by("title", F.when(F.col("title") != "", F.col("at"))).alias("title"), F.count("*").alias("n_visits"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def merge_pages(profiles: DataFrame) -> DataFrame:
    """Pages of several profiles as one: visits added, the first non-empty title (by first visit), at most four distinct queries in order."""
    p = profiles.groupBy("url").agg(
        F.sum("n_visits").alias("n_visits"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min_by("title", F.when(F.col("title") != "", F.col("first_at"))).alias("title"),
        F.array_sort(F.collect_list(F.struct("first_at", "queries"))).alias("q"),
    )
    return p.select("url", "title", "n_visits", "first_at", "last_at", F.slice(F.array_distinct(F.flatten(F.transform("q", lambda x: x["queries"]))), 1, 4).alias("queries"))


def session_rows(spark: SparkSession, path: str) -> DataFrame:
    """(session, at, speaker, text, is_meta, is_sidechain): a folder of JSON-lines session files; the content is a string or a list of typed parts, of which text parts count."""
    schema = "type string, cwd string, timestamp timestamp, isMeta boolean, isSidechain boolean, message struct<role: string, content: string>"
    raw = spark.read.schema(schema).json(path).withColumn("session", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?$", 1))
    parts = F.from_json(F.col("message.content"), "array<struct<type: string, text: string>>")
    said = F.when(F.col("message.content").startswith("["), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")).otherwise(F.col("message.content"))
    clean = F.trim(F.regexp_replace(said, r"(?is)<(system-reminder|command-[a-z]+|local-command-[a-z]+)>.*?</\1>", ""))
    return raw.where(F.col("type").isin("user", "assistant")).select("session", F.col("timestamp").alias("at"), F.coalesce("message.role", "type").alias("speaker"), clean.alias("text"), F.coalesce("isMeta", F.lit(False)).alias("is_meta"), F.coalesce("isSidechain", F.lit(False)).alias("is_sidechain"))
