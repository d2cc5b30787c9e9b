"""Store reads and writes, joins and aggregates over the project's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import scores, text
from cairn.operators import store
from cairn.plans.registry import query
from cairn.session import table

RECORD_COLUMNS = ["record_id", "project_id", "record_type", "what", "why", "rejected_alternatives", "outcome", "entities", "source_type", "source_url", "occurred_at", "confidence", "is_inference", "superseded_by", "content_hash", "ingested_at"]


def records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct records as last delivered, without their vectors."""
    wanted = [c for c in (columns or RECORD_COLUMNS) if c not in ("record_id", "ingested_at")]
    return store.latest(table(spark, d, "episodic_records", "record_id", *wanted, "ingested_at"), ["record_id"], "ingested_at")


def source_documents(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(table(spark, d, "source_documents"), ["document_id"], "indexed_at")


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct chunks; deliveries of a chunk are identical."""
    df = table(spark, d, "chunks", *(columns or ()))
    return df.groupBy("chunk_id").agg(*(F.first(c).alias(c) for c in df.columns if c != "chunk_id")).select(*df.columns)


R = "r AS (SELECT * EXCLUDE (embedding) FROM episodic_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) = 1)"
D = "d AS (SELECT * FROM source_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY indexed_at DESC) = 1)"
C = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ordinal) = 1)"


@query(f"WITH {R} SELECT record_id, project_id, record_type, confidence, occurred_at FROM r WHERE record_type IN ('decision', 'failure') AND confidence >= 0.6 AND superseded_by IS NULL AND occurred_at >= TIMESTAMP '2025-03-01'")
def b1_records_where(spark, d):
    found = store.records_where(records(spark, d), types=("decision", "failure"), least_confidence=0.6, since="2025-03-01 00:00:00")
    return found.select("record_id", "project_id", "record_type", "confidence", "occurred_at")


@query(f"WITH {R}, e AS (SELECT DISTINCT record_id FROM (SELECT record_id, unnest(entities) AS e FROM r) WHERE lower(e) IN ('spread', 'fold', 'meter')) SELECT record_id, project_id, record_type FROM r SEMI JOIN e USING (record_id)")
def b1_records_by_entity(spark, d):
    return store.records_where(records(spark, d), entities=("spread", "fold", "METER"), superseded=True).select("record_id", "project_id", "record_type")


@query(f"WITH {R}, t AS (SELECT * FROM r WHERE record_type = 'decision' ORDER BY confidence DESC NULLS LAST, record_id LIMIT 100) SELECT record_id, confidence FROM t WHERE len(list_filter(entities, lambda e: lower(e) = 'fold')) > 0 OR confidence > 0.9")
def b2_limit_before_filter(spark, d):
    """The limit is a feature here: the entity condition sees the hundred surest statements only."""
    top = records(spark, d).where("record_type = 'decision'").orderBy(F.desc("confidence"), "record_id").limit(100)
    return top.where(F.exists("entities", lambda e: F.lower(e) == "fold") | (F.col("confidence") > 0.9)).select("record_id", "confidence")


@query("SELECT project_id, project_key, project_name, last_active FROM projects WHERE git_remote IS NOT NULL ORDER BY last_active DESC, project_id")
def b5_projects(spark, d):
    return table(spark, d, "projects").where("git_remote is not null").orderBy(F.desc("last_active"), "project_id").select("project_id", "project_key", "project_name", "last_active")


@query(f"WITH {D} SELECT document_id, uri, source_type, indexed_at FROM d WHERE source_type = 'markdown'")
def b5_documents(spark, d):
    return source_documents(spark, d).where("source_type = 'markdown'").select("document_id", "uri", "source_type", "indexed_at")


@query(f"WITH {C} SELECT chunk_id, document_id, ordinal, length(text) AS n_chars FROM c")
def b6_all_chunks(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "document_id", "ordinal", F.length("text").cast("bigint").alias("n_chars")).distinct()


@query("SELECT content_hash, min(record_id) AS record_id, count(DISTINCT record_id) AS n FROM episodic_records GROUP BY content_hash")
def c1_insert_new(spark, d):
    """Insert-ignore by natural key: the first delivery of each content hash stays."""
    rows = table(spark, d, "episodic_records", "content_hash", "record_id", "ingested_at")
    stored = store.insert_new(rows.limit(0), rows, "content_hash", "record_id")
    return stored.select("content_hash", "record_id").join(rows.groupBy("content_hash").agg(F.count_distinct("record_id").alias("n")), "content_hash")


@query("""SELECT uri, arg_max(document_id, indexed_at) AS document_id, arg_max(content_hash, indexed_at) AS content_hash, min(indexed_at) AS first_indexed, max(indexed_at) AS indexed_at
FROM source_documents GROUP BY uri""")
def c2_upsert_documents(spark, d):
    rows = table(spark, d, "source_documents", "uri", "document_id", "content_hash", "indexed_at").withColumn("first_indexed", F.col("indexed_at"))
    return store.latest(rows, ["uri"], "indexed_at", first={"first_indexed": "indexed_at"}).select("uri", "document_id", "content_hash", "first_indexed", "indexed_at")


@query("""WITH old AS (SELECT * FROM source_documents WHERE indexed_at < TIMESTAMP '2025-07-01'), new AS (SELECT * FROM source_documents WHERE indexed_at >= TIMESTAMP '2025-07-01')
SELECT document_id, uri, indexed_at FROM new UNION ALL SELECT document_id, uri, indexed_at FROM old WHERE uri NOT IN (SELECT uri FROM new)""")
def c3_replace_documents(spark, d):
    rows = table(spark, d, "source_documents", "document_id", "uri", "indexed_at")
    cut = F.lit("2025-07-01").cast("timestamp_ntz")
    return store.replace_by_key(rows.where(F.col("indexed_at") < cut), rows.where(F.col("indexed_at") >= cut), "uri")


@query(f"""WITH {D}, {C}, k AS (SELECT document_id, count(*)::INT AS n FROM c WHERE length(text) >= 400 GROUP BY 1)
SELECT document_id, coalesce(n, 0)::INT AS chunk_count FROM d LEFT JOIN k USING (document_id)""")
def c4_delete_chunks(spark, d):
    """Chunks below 400 characters are deleted and the documents' counts taken again."""
    c = table(spark, d, "chunks").select("chunk_id", "document_id", F.length("text").alias("n")).distinct()
    short = c.where("n < 400").select("chunk_id")
    return store.recount(source_documents(spark, d), store.delete_by_key(c, short, "chunk_id")).select("document_id", "chunk_count")


@query("""SELECT record_id, arg_max(model, found_at) FILTER (model IS NOT NULL) AS model, arg_max(similarity, found_at) FILTER (similarity IS NOT NULL) AS similarity
FROM (SELECT record_id, model, similarity, found_at, hit_id FROM semantic_hits) GROUP BY record_id""")
def c6_fold_events(spark, d):
    return store.fold_events(table(spark, d, "semantic_hits"), "record_id", "found_at", "model", "similarity")


@query("""WITH p AS (SELECT project_key, root_path, languages, last_active FROM projects) SELECT project_key,
CASE WHEN root_path IS NULL THEN 'a manifest vanished' WHEN last_active < TIMESTAMP '2025-06-01' - INTERVAL 24 HOUR THEN 'older than a day' WHEN len(languages) = 0 THEN 'manifest digest differs' ELSE 'fresh' END AS state FROM p""")
def c7_fingerprint_staleness(spark, d):
    now = F.lit("2025-06-01").cast("timestamp_ntz")
    state = F.when(F.col("root_path").isNull(), "a manifest vanished").when(F.col("last_active") < now - F.expr("interval 24 hours"), "older than a day").when(F.size("languages") == 0, "manifest digest differs").otherwise("fresh")
    return table(spark, d, "projects").select("project_key", state.alias("state"))


@query(f"WITH {C}, {D} SELECT c.chunk_id, d.uri, d.project_key, c.ordinal FROM c JOIN d USING (document_id)")
def d1_chunks_with_documents(spark, d):
    return chunks(spark, d, "chunk_id", "document_id", "ordinal").join(source_documents(spark, d), "document_id").select("chunk_id", "uri", "project_key", "ordinal")


_SOUND = "embedding IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def sound_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    ok = (F.size(v) == 384) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table(spark, d, "episodic_records", "record_id", "embedding", "ingested_at").where(v.isNotNull()).where(ok).groupBy("record_id").agg(F.max_by("embedding", "ingested_at").alias("embedding"))


@query(f"SELECT DISTINCT record_id FROM episodic_records WHERE record_id NOT IN (SELECT record_id FROM episodic_records WHERE {_SOUND})")
def d4_without_vectors(spark, d):
    return store.without_vectors(table(spark, d, "episodic_records", "record_id").distinct(), sound_vectors(spark, d), "record_id")


@query("""WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), v AS (SELECT event_id AS purchase_id, user_id, ts AS purchased_at FROM events WHERE event_type = 'purchase')
SELECT event_id, user_id, purchase_id, purchased_at FROM (SELECT s.event_id, s.user_id, v.purchase_id, v.purchased_at, row_number() OVER (PARTITION BY s.event_id ORDER BY v.purchased_at, v.purchase_id) AS n
FROM s JOIN v ON s.user_id = v.user_id AND v.purchased_at BETWEEN s.ts AND s.ts + INTERVAL 720 MINUTE) WHERE n = 1""")
def d7_first_within_interval(spark, d):
    """Forward as-of join: the first purchase of the same user within twelve hours of a view."""
    from cairn.operators.joins import first_within

    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("purchased_at"))
    return first_within(views, bought, ["user_id"], "ts", "purchased_at", 720 * 60, id_col="event_id", tie="purchase_id").select("event_id", "user_id", "purchase_id", "purchased_at")


@query("""WITH a AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts AS err_ts, event_id AS err_id FROM events WHERE event_type = 'error')
SELECT a.event_id, a.user_id, b.err_id, b.err_ts FROM a ASOF JOIN (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_id, err_ts ORDER BY err_id DESC) = 1) b ON a.user_id = b.user_id AND a.ts >= b.err_ts""")
def d7_last_before(spark, d):
    """Backward as-of join without a range join: both sides in one sort, the last error carried forward."""
    from cairn.operators.joins import last_before

    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("err_ts"), F.col("event_id").alias("err_id"))
    return last_before(bought, errors, ["user_id"], "ts", "err_ts", ["err_id"]).where("err_id is not null")


@query("""WITH old AS (SELECT uri, arg_max(content_hash || coalesce(title, ''), indexed_at) AS v FROM source_documents WHERE indexed_at < TIMESTAMP '2025-09-01' GROUP BY uri),
new AS (SELECT uri, max(content_hash || coalesce(title, '')) AS v FROM source_documents WHERE document_id % 3 <> 0 GROUP BY uri)
SELECT coalesce(old.uri, new.uri) AS uri, CASE WHEN old.v IS NULL THEN 'new' WHEN new.v IS NULL THEN 'removed' WHEN old.v = new.v THEN 'unchanged' ELSE 'changed' END AS change FROM old FULL JOIN new ON old.uri = new.uri""")
def d8_snapshot_diff(spark, d):
    """Two states of the index, one a third of the documents short, compared."""
    rows = table(spark, d, "source_documents").withColumn("v", F.concat("content_hash", F.coalesce("title", F.lit(""))))
    before = rows.where(F.col("indexed_at") < F.lit("2025-09-01").cast("timestamp_ntz")).groupBy("uri").agg(F.max_by("v", "indexed_at").alias("v"))
    now = rows.where("document_id % 3 <> 0").groupBy("uri").agg(F.max("v").alias("v"))
    return store.snapshot_diff(before, now, "uri", "v")


_FP = "list_sort(list_distinct(list_filter(list_transform({c}, lambda x: lower(trim(x))), lambda x: x <> '')))"


def _overlap(c: str) -> str:
    return f"(CASE WHEN len(list_distinct(a.{c} || b.{c})) > 0 THEN len(list_intersect(a.{c}, b.{c})) / len(list_distinct(a.{c} || b.{c}))::DOUBLE END)"


@query(f"""WITH p AS (SELECT project_id, {_FP.format(c='dependencies')} AS dep, {_FP.format(c='frameworks')} AS fw, {_FP.format(c='languages')} AS lang FROM projects),
s AS (SELECT a.project_id AS project_a, b.project_id AS project_b, {_overlap('dep')} AS d, {_overlap('fw')} AS f, {_overlap('lang')} AS l FROM p a JOIN p b ON a.project_id < b.project_id)
SELECT project_a, project_b, round((coalesce(d, 0) * 0.5 + coalesce(f, 0) * 0.25 + coalesce(l, 0) * 0.15) / greatest(0.5, (CASE WHEN d IS NULL THEN 0 ELSE 0.5 END) + (CASE WHEN f IS NULL THEN 0 ELSE 0.25 END) + (CASE WHEN l IS NULL THEN 0 ELSE 0.15 END)), 4) AS similarity
FROM s WHERE coalesce(d, 0) + coalesce(f, 0) + coalesce(l, 0) > 0""")
def d11_sibling_projects(spark, d):
    """Projects that share a dependency, framework or language, by equi-join on what they share, with their likeness."""
    from cairn.operators.joins import sharing_pairs

    p = table(spark, d, "projects").select("project_id", text.clean_set("dependencies").alias("dep"), text.clean_set("frameworks").alias("fw"), text.clean_set("languages").alias("lang"))
    def tag(c: str):
        return F.transform(c, lambda x: F.concat(F.lit(f"{c}:"), x))

    tagged = F.concat(*(tag(c) for c in ("dep", "fw", "lang")))
    both = sharing_pairs(p.withColumn("all", tagged), "project_id", "all")
    a, b = (p.select(F.col("project_id").alias(f"project_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("dep", "fw", "lang"))) for x in "ab")
    pair = both.select(F.col("a").alias("project_a"), F.col("b").alias("project_b")).join(a, "project_a").join(b, "project_b")
    likeness = scores.fingerprint_similarity([(w, F.col(f"{c}_a"), F.col(f"{c}_b")) for w, c in ((0.5, "dep"), (0.25, "fw"), (0.15, "lang"))])
    return pair.select("project_a", "project_b", F.round(likeness, 4).alias("similarity"))


@query(f"WITH {R} SELECT record_id, coalesce(project_key, 'unknown') AS project_key FROM r LEFT JOIN (SELECT project_id, project_key FROM projects WHERE git_remote IS NOT NULL) p USING (project_id)")
def d12_record_projects(spark, d):
    known = table(spark, d, "projects").where("git_remote is not null").select("project_id", "project_key")
    return records(spark, d, "project_id").join(known, "project_id", "left").select("record_id", F.coalesce("project_key", F.lit("unknown")).alias("project_key"))


@query(f"WITH {R}, {D}, {C} SELECT (SELECT count(*) FROM r) AS n_records, (SELECT count(*) FROM d) AS n_documents, (SELECT count(*) FROM c) AS n_chunks, (SELECT count(DISTINCT record_id) FROM episodic_records WHERE {_SOUND}) AS n_vectors")
def e1_counts(spark, d):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(table(spark, d, t, k).distinct(), n) for t, k, n in (("episodic_records", "record_id", "n_records"), ("source_documents", "document_id", "n_documents"), ("chunks", "chunk_id", "n_chunks"))]
    return parts[0].join(parts[1]).join(parts[2]).join(one(sound_vectors(spark, d), "n_vectors"))


@query("SELECT DISTINCT project_key FROM source_documents WHERE project_key IS NOT NULL ORDER BY 1")
def e3_document_projects(spark, d):
    return table(spark, d, "source_documents", "project_key").where("project_key is not null").distinct().orderBy("project_key")


@query(f"WITH {D} SELECT source_type, project_key, count(*) AS n_documents, coalesce(sum(chunk_count), 0)::BIGINT AS n_passages FROM d GROUP BY 1, 2")
def e4_knowledge_summary(spark, d):
    return source_documents(spark, d).groupBy("source_type", "project_key").agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("n_passages"))


@query(f"WITH {D} SELECT source_type, project_key, count(*) AS n_documents, sum(chunk_count)::BIGINT AS n_passages FROM d GROUP BY GROUPING SETS ((source_type), (project_key))")
def e5_marginal_summaries(spark, d):
    source_documents(spark, d).createOrReplaceTempView("cairn_documents")
    return spark.sql("SELECT source_type, project_key, count(*) AS n_documents, sum(chunk_count) AS n_passages FROM cairn_documents GROUP BY GROUPING SETS ((source_type), (project_key))")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 20) AS n_served, round(avg(value), 6) AS mean_value, list_sort(list(value))[round_even(0.95 * (count(*) - 1), 0)::INT + 1] AS p95,
min(ts) AS first_at, max(ts) AS last_at, round(count(*) FILTER (value > 20) / count(*), 6) AS rate FROM events GROUP BY event_type""")
def events_usage(spark, d):
    """Usage by kind of event, with the nearest-rank percentile (halves to even)."""
    e = table(spark, d, "events", "event_type", "value", "ts")
    base = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("n_served"), F.round(F.avg("value"), 6).alias("mean_value"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    base = base.withColumn("rate", F.round(F.col("n_served") / F.col("n"), 6))
    return base.join(store.nearest_rank_by(e, ["event_type"], "value", 0.95, "p95"), "event_type").select("event_type", "n", "n_served", "mean_value", "p95", "first_at", "last_at", "rate")


@query(f"""WITH {R} SELECT record_type, project_id, count(*) AS n, count(*) FILTER (NOT is_inference) AS n_stated, round(count(*) FILTER (NOT is_inference) / count(*), 6) AS share_stated,
strftime(min(occurred_at), '%Y-%m') AS first_month, strftime(max(occurred_at), '%Y-%m') AS last_month FROM r GROUP BY 1, 2""")
def e7_ingest_status(spark, d):
    stated = F.count_if(~F.col("is_inference"))
    return records(spark, d, "record_type", "project_id", "is_inference", "occurred_at").groupBy("record_type", "project_id").agg(
        F.count("*").alias("n"), stated.alias("n_stated"), F.round(stated / F.count("*"), 6).alias("share_stated"), F.date_format(F.min("occurred_at"), "yyyy-MM").alias("first_month"), F.date_format(F.max("occurred_at"), "yyyy-MM").alias("last_month")
    )


@query("""WITH h AS (SELECT DISTINCT record_id, neighbour_id, similarity FROM semantic_hits WHERE similarity IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY similarity DESC, neighbour_id) AS pos FROM h QUALIFY pos <= 5),
j AS (SELECT k.record_id, k.pos, (similarity >= 0.65)::INT AS gain FROM k), q AS (SELECT record_id, sum(gain) AS hits, count(*) AS served, coalesce(sum(gain / log2(pos + 1)), 0) AS dcg, min(CASE WHEN gain = 1 THEN pos END) AS first_hit FROM j GROUP BY 1),
i AS (SELECT q.*, (SELECT sum(1 / log2(x + 1)) FROM range(1, least(5, hits)::INT + 1) t(x)) AS ideal FROM q)
SELECT record_id, round(hits / served, 6) AS precision_at_5, round(coalesce(1.0 / first_hit, 0), 6) AS reciprocal_rank, round(coalesce(dcg / ideal, 0), 6) AS ndcg_at_5 FROM i""")
def e10_retrieval_metrics(spark, d):
    from cairn.operators.evaluation import ranked_metrics

    hits = table(spark, d, "semantic_hits", "record_id", "neighbour_id", "similarity").where("similarity is not null").distinct()
    served = store.top_k(hits, ["record_id"], [F.desc("similarity"), F.col("neighbour_id")], 5, "pos").withColumn("gain", (F.col("similarity") >= 0.65).cast("int"))
    return ranked_metrics(served, "record_id", "pos", "gain", 5)


@query("""WITH q AS (SELECT session_id, project_key, max(length(user_text)) AS n FROM transcript_rows GROUP BY 1, 2) SELECT project_key, count(*) AS n_sessions, max(n) AS longest FROM q GROUP BY GROUPING SETS ((project_key), ())""")
def sessions_by_project(spark, d):
    t = table(spark, d, "transcript_rows", "session_id", "project_key", "user_text").groupBy("session_id", "project_key").agg(F.max(F.length("user_text")).cast("bigint").alias("n"))
    return t.rollup("project_key").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@query("""SELECT root, dir, n FROM (SELECT root, split_part(substr(uri, length(root) + 2), '/', 1) AS dir, count(DISTINCT document_id) AS n FROM source_documents WHERE starts_with(uri, root || '/') GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, dir) <= 20""")
def e16_directory_shape(spark, d):
    """The twenty fullest top directories of each root."""
    rows = table(spark, d, "source_documents", "root", "uri", "document_id").where(F.startswith("uri", F.concat("root", F.lit("/"))))
    dir_ = F.split_part(F.substring("uri", F.length("root") + 2, F.length("uri")), F.lit("/"), F.lit(1))
    return store.top_k(rows.groupBy("root", dir_.alias("dir")).agg(F.count_distinct("document_id").alias("n")), ["root"], [F.desc("n"), F.col("dir")], 20).drop("rank")


@query(r"""WITH f AS (SELECT DISTINCT document_id, regexp_extract(uri, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_extract(uri, '\.([A-Za-z0-9]+)$', 1)) AS suffix FROM source_documents)
SELECT document_id, folder, suffix FROM f QUALIFY count(*) OVER (PARTITION BY folder, suffix) <= 2""")
def e17_flood_guard(spark, d):
    """Files of a suffix that floods a folder are left out (here: more than two, so that the small tables have such folders). The counts are aggregated, then joined: no window over a folder."""
    f = table(spark, d, "source_documents", "document_id", "uri").select("document_id", F.regexp_extract("uri", r"^(.*)/[^/]*$", 1).alias("folder"), F.lower(F.regexp_extract("uri", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix")).distinct()
    return f.join(f.groupBy("folder", "suffix").count().where("count <= 2"), ["folder", "suffix"]).select("document_id", "folder", "suffix")


@query(f"""WITH h AS (SELECT hit_id, record_id, neighbour_id FROM semantic_hits), v AS (SELECT record_id, arg_max(embedding, ingested_at) AS e FROM episodic_records WHERE {_SOUND} GROUP BY 1)
SELECT hit_id, round(list_cosine_similarity(a.e, b.e)::DOUBLE, 4) AS similarity FROM h JOIN v a ON a.record_id = h.record_id JOIN v b ON b.record_id = h.neighbour_id""")
def i31_cosine_of_hits(spark, d):
    """Logged similarities taken again from the vectors."""
    v = sound_vectors(spark, d)
    h = table(spark, d, "semantic_hits", "hit_id", "record_id", "neighbour_id")
    both = h.join(v, "record_id").withColumnRenamed("embedding", "a").join(v.select(F.col("record_id").alias("neighbour_id"), F.col("embedding").alias("b")), "neighbour_id")
    return both.select("hit_id", F.round(scores.cosine(F.col("a"), F.col("b")), 4).alias("similarity"))


@query(f"""WITH {R} SELECT record_id, lower(r.source_type || '/' || record_type || '/' || record_id) AS uri, concat_ws(chr(10), nullif(what, ''), nullif(why, ''), nullif(outcome, '')) AS text, occurred_at AS mtime FROM r""")
def k15_mirror_records(spark, d):
    """Records as one-passage documents."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("what", "why", "outcome")]
    uri = F.lower(F.concat("source_type", F.lit("/"), "record_type", F.lit("/"), F.col("record_id").cast("string")))
    return records(spark, d).select("record_id", uri.alias("uri"), F.concat_ws("\n", *parts).alias("text"), F.col("occurred_at").alias("mtime"))


@query("""WITH a AS (SELECT DISTINCT project_key FROM documents WHERE lower(lang) = 'en'), b AS (SELECT DISTINCT project_key FROM chunks WHERE project_key IS NOT NULL), e AS (SELECT DISTINCT project_key FROM eval_items WHERE project_key IS NOT NULL)
SELECT project_key, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT project_key, 'questions only' FROM (SELECT * FROM e EXCEPT SELECT * FROM b) UNION ALL SELECT project_key, 'any' FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM e)""")
def l_set_operations(spark, d):
    a = table(spark, d, "documents").where("lower(lang) = 'en'").select("project_key").distinct()
    b = table(spark, d, "chunks", "project_key").where("project_key is not null").distinct()
    e = table(spark, d, "eval_items", "project_key").where("project_key is not null").distinct()
    named = lambda df, side: df.select("project_key", F.lit(side).alias("side"))
    return named(a.intersect(b), "both").unionByName(named(e.subtract(b), "questions only")).unionByName(named(a.union(b).union(e).distinct(), "any"))


@query("SELECT item_id FROM eval_items WHERE (expect = 'nothing' AND passage IS NOT NULL) OR (expect = 'something' AND passage IS NULL)")
def eval_label_consistency(spark, d):
    return table(spark, d, "eval_items").where("(expect = 'nothing' and passage is not null) or (expect = 'something' and passage is null)").select("item_id")


@query(f"WITH {R} SELECT entity, count(DISTINCT record_id) AS n FROM (SELECT record_id, lower(trim(unnest(entities))) AS entity FROM r) WHERE entity <> '' GROUP BY 1 QUALIFY row_number() OVER (ORDER BY n DESC, entity) <= 25")
def top_entities(spark, d):
    """The 25 entities of most records."""
    e = records(spark, d, "entities").select("record_id", F.explode(text.clean_set("entities")).alias("entity")).groupBy("entity").agg(F.count_distinct("record_id").alias("n"))
    return e.orderBy(F.desc("n"), "entity").limit(25)


@query("""SELECT doc_id, project_key, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(uri || doc_id)) AS rn FROM documents) ORDER BY rn, source LIMIT 40""")
def f11_round_robin_sample(spark, d):
    """A sampling operator: forty documents, drawn in turns over the sources in a fixed pseudo-random order."""
    turn = store.top_k(table(spark, d, "documents", "doc_id", "project_key", "source", "uri"), ["source"], [F.md5(F.concat("uri", F.col("doc_id").cast("string")))], 40, "rn")
    return turn.orderBy("rn", "source").limit(40).select("doc_id", "project_key", "source")
