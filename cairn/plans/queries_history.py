"""History of prompts: what users asked in the logged sessions, and whether a reply was delivered, taken as entries of the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scores, text
from cairn.operators import history
from cairn.plans.queries_store import _SOUND, sound_vectors
from cairn.plans.registry import query
from cairn.session import table


def entries(spark: SparkSession, d: str) -> DataFrame:
    """A user's message is a prompt; the latency is the time to its first delivery, feedback is given where a row was delivered again."""
    cols = ["message_id", "session_id", "project_key", "turn_number", "turn_timestamp", "user_text", "is_meta", "is_sidechain", "cwd", "received_at"]
    t = table(spark, d, "transcript_rows", *cols).where("trim(user_text) <> '' and turn_timestamp is not null")
    rest = [c for c in cols if c not in ("message_id", "received_at")]
    one = t.groupBy("message_id").agg(*(F.max(c).alias(c) for c in rest), F.min("received_at").alias("first_at"), F.count("*").alias("times"))
    ids = lambda c: F.when(c, F.array("message_id")).otherwise(F.array().cast("array<bigint>"))
    late = (F.unix_micros(F.col("first_at").cast("timestamp")) - F.unix_micros(F.col("turn_timestamp").cast("timestamp"))) / 1000
    return one.select(
        F.col("message_id").alias("bundle_id"), F.col("turn_timestamp").alias("created_at"), "project_key", F.when(F.col("is_meta"), "search").otherwise("implement").alias("task_type"), "session_id", "cwd",
        F.col("user_text").alias("prompt_text"), F.lit(None).cast("string").alias("rendered_text"), F.when(F.col("is_sidechain"), "hook").otherwise("api").alias("source"), F.col("turn_number").isNotNull().alias("injected"), late.alias("latency_ms"),
        F.lit(0).alias("profile_tokens"), F.lit(0).alias("episodic_tokens"), text.token_estimate("user_text").alias("evidence_tokens"), ids(F.col("is_meta")).alias("episodic_ids"), ids(F.col("is_sidechain")).alias("cross_project_ids"), F.when(F.col("times") > 1, F.col("cwd").isNotNull()).alias("feedback"),
    )


_H = r"""h AS (SELECT message_id AS bundle_id, max(turn_timestamp) AS created_at, max(project_key) AS project_key, CASE WHEN max(is_meta::INT) = 1 THEN 'search' ELSE 'implement' END AS task_type, max(cwd) AS cwd, max(user_text) AS prompt_text,
CASE WHEN max(is_sidechain::INT) = 1 THEN 'hook' ELSE 'api' END AS source, max(turn_number) IS NOT NULL AS injected, (epoch_us(min(received_at)) - epoch_us(max(turn_timestamp))) / 1000.0::DOUBLE AS latency_ms,
CASE WHEN length(max(user_text)) = 0 THEN 0 ELSE greatest(1, ceil(greatest(length(max(user_text)) / 3.6::DOUBLE, len(regexp_extract_all(max(user_text), '\S+')) * 1.35::DOUBLE)))::BIGINT END AS tokens, max(is_meta::INT) = 1 AS episodic, max(is_sidechain::INT) = 1 AS crossing,
CASE WHEN count(*) > 1 THEN max(cwd) IS NOT NULL END AS feedback FROM transcript_rows WHERE trim(user_text, ' ') <> '' AND turn_timestamp IS NOT NULL GROUP BY 1)"""


@query(rf"""WITH {_H}, e AS (SELECT project_key FROM projects WHERE project_id % 5 = 0)
SELECT bundle_id, substr(sha256(lower(trim(prompt_text, ' '))), 1, 16) AS prompt_hash, len(regexp_extract_all(prompt_text, '\S+')) AS prompt_words, CASE WHEN project_key IS NOT NULL AND project_key IN (SELECT project_key FROM e) THEN NULL ELSE md5(prompt_text) END AS kept FROM h""")
def c8_logged(spark, d):
    """The history as stored: texts of excluded projects (here: every fifth) are not kept."""
    held = table(spark, d, "projects", "project_id", "project_key").where("project_id % 5 = 0")
    return history.log(entries(spark, d), "full", held).select("bundle_id", "prompt_hash", "prompt_words", F.md5("prompt_text").alias("kept"))


@query(f"WITH {_H} SELECT bundle_id, created_at, project_key FROM h WHERE injected AND source = 'api' AND created_at >= TIMESTAMP '2025-03-01' ORDER BY created_at DESC, bundle_id LIMIT 50")
def b3_found(spark, d):
    """A history list: the newest fifty entries under a filter."""
    return history.find(entries(spark, d), served=True, source="api", since="2025-03-01 00:00:00").select("bundle_id", "created_at", "project_key")


@query(f"""WITH {_H}, p AS (SELECT DISTINCT substr(bundle_id::VARCHAR, 1, 3) AS prefix FROM h UNION SELECT 'x1')
SELECT prefix, CASE WHEN count(bundle_id) = 1 THEN min(bundle_id) END AS bundle_id, CASE WHEN count(bundle_id) = 1 THEN 'found' WHEN count(bundle_id) > 1 THEN 'ambiguous' ELSE 'unknown' END AS state FROM p LEFT JOIN h ON starts_with(bundle_id::VARCHAR, prefix) AND length(bundle_id::VARCHAR) >= length(prefix) GROUP BY 1""")
def b7_prefixes(spark, d):
    e = entries(spark, d)
    asked = e.select(F.substring(F.col("bundle_id").cast("string"), 1, 3).alias("prefix")).union(spark.range(1).select(F.lit("x1"))).distinct()
    return history.resolve(e, asked)


@query(f"""WITH {_H} SELECT count(*) AS bundles, count(*) FILTER (injected) AS injected, count(*) FILTER (NOT injected) AS skipped, count(*) FILTER (episodic) AS with_episodic, count(*) FILTER (crossing) AS cross_project, sum(tokens)::BIGINT AS tokens,
count(*) FILTER (feedback) AS helpful, count(*) FILTER (NOT feedback) AS unhelpful, round(avg(latency_ms), 4) AS mean_latency_ms, min(created_at) AS first_seen, max(created_at) AS last_seen, round(count(*) FILTER (injected) / count(*), 6) AS injection_rate,
round(count(*) FILTER (NOT feedback) / nullif(count(feedback), 0), 6) AS false_injection_rate, list_sort(list(latency_ms))[round_even(0.95 * (count(*) - 1), 0)::INT + 1] AS p95_latency_ms FROM h""")
def e6_usage(spark, d):
    return history.usage(entries(spark, d))


@query(f"WITH {_H} SELECT project_key, count(*) AS n FROM h WHERE project_key IS NOT NULL GROUP BY 1")
def e6_usage_by_project(spark, d):
    return history.usage_by(entries(spark, d), "project_key")


@query(f"WITH {_H} SELECT bundle_id FROM h WHERE created_at >= TIMESTAMP '2025-06-01'")
def c4_purged(spark, d):
    return history.purge(entries(spark, d), F.lit("2025-06-01").cast("timestamp_ntz")).select("bundle_id")


@query(f"""WITH {_H}, n AS (SELECT * FROM h WHERE injected ORDER BY created_at DESC, bundle_id LIMIT 200), s AS (SELECT trim(prompt_text, ' ') AS prompt, project_key, created_at, bundle_id FROM n WHERE length(trim(prompt_text, ' ')) BETWEEN 1 AND 160),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lower(prompt) ORDER BY created_at DESC, bundle_id) = 1) SELECT prompt, project_key, created_at FROM o ORDER BY created_at DESC, bundle_id LIMIT 6""")
def k21_suggestions(spark, d):
    return history.suggestions(entries(spark, d))


@query(f"""WITH v AS (SELECT record_id, arg_max(embedding, ingested_at) AS e FROM episodic_records WHERE {_SOUND} GROUP BY 1), l AS (SELECT DISTINCT record_id, neighbour_id FROM semantic_hits),
a AS (SELECT l.* FROM l JOIN v x USING (record_id) JOIN v y ON y.record_id = neighbour_id WHERE list_cosine_similarity(x.e, y.e) >= 0.65),
g AS (SELECT record_id, list_sort(list(neighbour_id)) AS gone FROM (SELECT * FROM l EXCEPT SELECT * FROM a) GROUP BY 1) SELECT DISTINCT record_id, coalesce(gone, []) AS gone, []::BIGINT[] AS new FROM l LEFT JOIN g USING (record_id)""")
def k20_replayed(spark, d):
    """Logged searches run again: which of the neighbours served then would not be served now."""
    logged = table(spark, d, "semantic_hits", "record_id", "neighbour_id").distinct()
    v = sound_vectors(spark, d)
    both = logged.join(v, "record_id").withColumnRenamed("embedding", "a").join(v.select(F.col("record_id").alias("neighbour_id"), F.col("embedding").alias("b")), "neighbour_id")
    again = both.where(scores.cosine(F.col("a"), F.col("b")) >= 0.65).select("record_id", "neighbour_id")
    return history.replay_diff(logged, again, "record_id", "neighbour_id")


@query("SELECT count(*) AS resolved, count(*) FILTER (toxic = 1) AS accepted, count(*) FILTER (toxic = 0) AS rejected, round(count(*) FILTER (toxic = 1) / count(*), 6) AS acceptance_rate FROM (SELECT DISTINCT label_id, toxic FROM content_labels) WHERE toxic IS NOT NULL")
def e15_acceptance(spark, d):
    """The raters' decisions taken as reviews: 1 confirms, 0 rejects, none is open."""
    labels = table(spark, d, "content_labels", "label_id", "toxic").distinct()
    return history.acceptance(labels.select("label_id", F.when(F.col("toxic") == 1, "confirm").when(F.col("toxic") == 0, "reject").alias("resolution")))
