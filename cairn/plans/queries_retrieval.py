"""Searches for the evaluation questions, as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import embedding, render, scores, text
from cairn.operators import chunking, folds, gate, retrieval
from cairn.operators import store
from cairn.plans.durable import durable
from cairn.plans.queries_rules import _PIECES, _TERMS, NOW
from cairn.plans.queries_store import C, D, R, records, source_documents
from cairn.plans.registry import query
from cairn.session import spread, table


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "prompt", "project_key")


def passages(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Passages as delivered, some of them twice."""
    return spread(table(spark, d, "chunks", "chunk_id", "heading", "text", *more))


def places(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, uri, title, project_key): no texts."""
    docs = source_documents(spark, d).select("document_id", "uri", "title", F.col("project_key").alias("doc_project"))
    c = table(spark, d, "chunks", "chunk_id", "document_id", "project_key").dropDuplicates(["chunk_id"])
    return c.join(docs, "document_id", "left").select("chunk_id", "uri", "title", F.coalesce("doc_project", "project_key").alias("project_key"))


_POST = f"""{C}, k AS (SELECT chunk_id, list_transform({_PIECES.format(c="coalesce(heading, '')")}, lambda p: lower(p)) AS h, list_transform({_PIECES.format(c='text')}, lambda p: lower(p)) AS t FROM c),
q AS (SELECT item_id AS query_id, unnest(terms) AS term FROM (SELECT item_id, {_TERMS} AS terms FROM eval_items)),
post AS (SELECT term, chunk_id, sum(w) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(h) + len(t) AS dl, unnest(list_transform(h, lambda x: {{'term': x, 'w': 3.0}}) || list_transform(t, lambda x: {{'term': x, 'w': 1.0}}), recursive := true) FROM k) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
size AS (SELECT count(*) AS total, avg(len(h) + len(t)) AS mean_length FROM k), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
w AS (SELECT query_id, term, coalesce(df, 0) AS df, total, mean_length FROM q LEFT JOIN df USING (term), size WHERE NOT (total >= 200 AND coalesce(df, 0) / total > 0.25))"""


@query(f"WITH {_POST} SELECT query_id, term, df, round(CASE WHEN df = 0 THEN 0.75 * ln(1 + (total - 0.5) / 1.5) ELSE ln(1 + (total - df + 0.5) / (df + 0.5)) END, 6) AS weight FROM w")
def e2_term_weights(spark, d):
    p, terms = passages(spark, d), retrieval.query_terms(questions(spark, d))
    posted, size = retrieval.index(p, terms)
    weighted = retrieval.weights(terms, posted, size)
    return weighted.select("query_id", "term", "df", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_POST}, b AS (SELECT query_id, chunk_id, round(sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_length))), 6) AS bm25 FROM w JOIN post USING (term) WHERE df > 0 GROUP BY 1, 2)
SELECT query_id, chunk_id, bm25 FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) <= 40""")
def k1_search_chunks(spark, d):
    p, terms = passages(spark, d), retrieval.query_terms(questions(spark, d))
    posted, size = retrieval.index(p, terms)
    return retrieval.search(retrieval.weights(terms, posted, size), posted, size).select("query_id", "chunk_id", "bm25")


@query()
def k1_search_stemmed(spark, d):
    """The same search over stems: distinct terms of the passages are stemmed once and joined, so each question's terms widen to all words of their stems."""
    p, terms = passages(spark, d), retrieval.query_terms(questions(spark, d))
    words = p.select(F.explode(text.vocabulary(F.concat_ws(" ", F.coalesce("heading", F.lit("")), "text"))).alias("term")).distinct().withColumn("stem", embedding.stem("term"))
    asked = terms.withColumn("term", embedding.stem("term")).groupBy("query_id", "term").agg(F.min("pos").alias("pos"))
    widened = words.join(asked.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi")
    posted, size = retrieval.index(p, widened.select("term"))
    merged = posted.join(widened, "term").groupBy(F.col("stem").alias("term"), "chunk_id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    return retrieval.search(retrieval.weights(asked, merged, size), merged, size).select("query_id", "chunk_id", "bm25", "rank")


@query()
def k2_evidence(spark, d):
    """The flagship: cited passages per question, and why the other candidates were cut."""
    keys = source_documents(spark, d).select("project_key").where("project_key is not null").distinct()
    found = retrieval.evidence(questions(spark, d), passages(spark, d), places(spark, d), keys)
    return found.select("query_id", "chunk_id", "score", "coverage", "outcome", "pos")


def _similar(spark: SparkSession, d: str, k: int = 12) -> DataFrame:
    """Questions and passages by hashed vectors: the stated questions against all passages, one matrix product a batch."""
    from cairn.operators.vectors import similar_to

    p = passages(spark, d).select("chunk_id", F.substring("text", 1, 1200).alias("text"))  # the rule: a passage's vector is that of its beginning
    near = similar_to(questions(spark, d).select("query_id", "prompt"), p, k)
    return near.join(places(spark, d).select("chunk_id", "uri"), "chunk_id")


def _by_meaning(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    p, terms = passages(spark, d), retrieval.query_terms(questions(spark, d))
    rare = retrieval.distinctive(terms, *retrieval.index(p, terms))
    return retrieval.by_meaning(_similar(spark, d), rare, p, places(spark, d), threshold=threshold)


@query()
def k3_by_meaning(spark, d):
    """Passages that say what a question asks in other words, and share a distinctive word with it; the threshold is a learned encoder's."""
    return _by_meaning(spark, d, 0.80)


@query()
def k3_by_meaning_hashed(spark, d):
    """The same with a threshold that hashed vectors can reach."""
    return _by_meaning(spark, d, 0.30)


@query()
def k4_retrieve(spark, d):
    """Served evidence, filled up to its limit with passages by meaning."""
    q, p, at = questions(spark, d), passages(spark, d), places(spark, d)
    keys = source_documents(spark, d).select("project_key").where("project_key is not null").distinct()
    terms = retrieval.query_terms(q)
    indexed = retrieval.index(p, terms)
    served = durable(retrieval.evidence(q, p, at, keys, indexed).where("outcome = 'served'").select("query_id", "chunk_id", "score"), "served")
    near = retrieval.by_meaning(_similar(spark, d), retrieval.distinctive(terms, *indexed), p, at, served)
    return retrieval.filled(served, near)


@query()
def f13_excerpts(spark, d):
    """The lines to show of each served passage, and where they stand."""
    asked = retrieval.query_terms(questions(spark, d)).groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    served = k2_evidence(spark, d).where("outcome = 'served'").select("query_id", "chunk_id")
    said = passages(spark, d, "start_line", "end_line").join(served.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    shown = chunking.excerpt(F.col("text"), F.col("start_line"), F.col("end_line"), F.col("terms"))
    return served.join(said, "chunk_id").join(asked, "query_id").select("query_id", "chunk_id", shown.alias("x")).select("query_id", "chunk_id", "x.*")


def _explore(spark: SparkSession, d: str, floor: float) -> DataFrame:
    terms = retrieval.query_terms(questions(spark, d))
    posted, size = retrieval.index(passages(spark, d), terms)
    words = retrieval.search(retrieval.frequencies(terms, posted), posted, size, 8)
    return retrieval.explore(words, _similar(spark, d, 24), places(spark, d), floor=floor)


@query()
def k5_explore(spark, d):
    """Explicit search: the 8 best by words, then of the 24 nearest by meaning what words did not find; the floor is a learned encoder's."""
    return _explore(spark, d, 0.6)


@query()
def k5_explore_hashed(spark, d):
    """The same with a floor that hashed vectors can reach."""
    return _explore(spark, d, 0.25)


@query()
def i17_cited_excerpts(spark, d):
    """Served passages as they are handed out: heading or title, exact place, quoted lines, redacted."""
    shown = f13_excerpts(spark, d)
    at = places(spark, d).join(table(spark, d, "chunks", "chunk_id", "document_id", "heading", "locator").dropDuplicates(["chunk_id"]), "chunk_id").join(source_documents(spark, d).select("document_id", "source_type"), "document_id", "left")
    x = shown.join(at, "chunk_id")
    place = render.citation(F.col("uri"), F.col("start"), F.col("end"), F.col("locator"))
    label = F.coalesce(F.nullif(F.col("heading"), F.lit("")), F.nullif(F.col("title"), F.lit("")), F.col("uri"))
    return x.select("query_id", "chunk_id", place.alias("citation"), render.evidence(F.col("source_type"), F.coalesce("project_key", F.lit("unknown")), label, place, F.col("excerpt")).alias("rendered"))


@query(f"""WITH {R}, p AS (SELECT project_id, project_key FROM projects) SELECT record_id, '- **[' || record_type || '] ' || coalesce(project_key, 'unknown') || '** (' || strftime(occurred_at, '%Y-%m') || ') — ' || what
|| CASE WHEN coalesce(why, '') <> '' THEN chr(10) || CASE WHEN is_inference THEN '  - inferred reason: ' ELSE '  - reason: ' END || why ELSE '' END || CASE WHEN coalesce(outcome, '') <> '' THEN chr(10) || '  - outcome: ' || outcome ELSE '' END
|| CASE WHEN source_url IS NOT NULL THEN chr(10) || '  - source: ' || source_url ELSE '' END AS rendered FROM r LEFT JOIN p USING (project_id)""")
def i17_rendered_records(spark, d):
    r = records(spark, d).join(table(spark, d, "projects", "project_id", "project_key"), "project_id", "left")
    c = F.col
    return r.select("record_id", render.record(c("record_type"), F.coalesce("project_key", F.lit("unknown")), c("occurred_at"), c("what"), c("why"), c("is_inference"), c("outcome"), c("source_url")).alias("rendered"))


@query()
def e11_evaluation(spark, d):
    """One row: how the served evidence does on the evaluation questions that expect something and on those that expect silence."""
    from cairn.operators.evaluation import summary

    expect = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), (F.col("expect") == "something").alias("wanted"))
    served = k2_evidence(spark, d).where("outcome = 'served'").groupBy("query_id").agg(F.count("*").alias("n"))
    each = expect.join(served, "query_id", "left").select("query_id", "wanted", F.col("n").isNotNull().alias("served"), F.when(F.col("n").isNotNull(), F.col("wanted").cast("double")).alias("right"))
    return summary(each, precision="right", expected="wanted", served="served")


def _record_questions(spark: SparkSession, d: str) -> DataFrame:
    from cairn.plans.queries_rules import b10_gate, i13_named_entities

    gates = b10_gate(spark, d).select(F.col("item_id").alias("query_id"), "task", "record_types").where(F.size("record_types") > 0)
    named = i13_named_entities(spark, d).select(F.col("item_id").alias("query_id"), F.col("named").alias("entities"))
    return questions(spark, d).join(gates, "query_id").join(named, "query_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def _ranked_records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, record_id, score, rank), and the records that some question may see."""
    from cairn.operators.vectors import similar_records

    # Written tables: each is read by several steps, and one plan over two of them outgrows the driver.
    q = durable(_record_questions(spark, d), "questions")
    r = durable(records(spark, d), "records")
    pool = durable(retrieval.record_pool(q, r), "pool")
    # Words and vectors are taken of these only.
    r = durable(r.join(pool.select("record_id").distinct(), "record_id", "left_semi"), "pooled")
    lexical = durable(retrieval.record_bm25(q, pool, r), "lexical")
    said = r.select("record_id", F.concat_ws(" ", "what", "why", "outcome").alias("text"))
    vector = durable(similar_records(q.select("query_id", "prompt"), said, pool.select("query_id", "record_id")), "similar")
    covered = durable(retrieval.record_coverage(q, pool, r), "covered")
    fused = durable(retrieval.fuse(lexical, vector, covered), "fused")
    return retrieval.rank_records(fused, pool, q, r, table(spark, d, "projects"), F.lit(NOW).cast("timestamp_ntz")), r


@query()
def k6_hybrid_records(spark, d):
    """History records per question: pool, BM25 and vectors, fusion, ranking, floors."""
    return _ranked_records(spark, d)[0]


@query(f"""WITH r AS (SELECT record_id, lower(concat_ws(' ', what, why, outcome, array_to_string(entities, ' '))) AS said FROM (SELECT * EXCLUDE (embedding) FROM episodic_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) = 1)),
w AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(prompt), '\\s+'), lambda x: length(x) > 2))) AS word FROM eval_items), n AS (SELECT query_id, count(*) AS n FROM w GROUP BY 1)
SELECT query_id, record_id, round(count(*) / any_value(n)::DOUBLE, 6) AS score FROM w JOIN r ON contains(said, word) JOIN n USING (query_id) GROUP BY 1, 2""")
def k8_word_share(spark, d):
    """A part of explicit search: the share of a question's words that a record holds."""
    return retrieval.word_share(questions(spark, d), records(spark, d))


@query()
def k8_search_memory(spark, d):
    """Explicit search of the records: words and named entities, ranked, with floor and limit."""
    return retrieval.search_memory(questions(spark, d), records(spark, d), table(spark, d, "projects"), F.lit(NOW).cast("timestamp_ntz"))


@query()
def k12_context(spark, d):
    """Whole answers: passages and records within their token budgets, passages first; a question nothing answers keeps a row that says so."""
    q = questions(spark, d)
    # Written tables: a plan over the searches and the budgets outgrows the driver, and only served texts are measured.
    served = durable(k2_evidence(spark, d).where("outcome = 'served'").select("query_id", "chunk_id", "score"), "served")
    said = table(spark, d, "chunks", "chunk_id", "text").join(served.select("chunk_id").distinct(), "chunk_id", "left_semi")
    sizes = said.select("chunk_id", text.token_estimate("text").alias("tokens")).distinct()
    served = served.join(sizes, "chunk_id").select("query_id", F.lit("passage").alias("kind"), F.col("chunk_id").alias("id"), "score", "tokens")
    passages_ = folds.fit_budget(served, ["query_id", "kind"], [-F.col("score"), F.col("id")], "tokens", 1200, 4)
    ranked, pooled = _ranked_records(spark, d)
    history = durable(ranked, "ranked").join(pooled.select("record_id", "what", "why"), "record_id").select("query_id", F.lit("record").alias("kind"), F.col("record_id").alias("id"), "score", text.token_estimate(F.concat_ws(" ", "what", "why")).alias("tokens"))
    records_ = folds.fit_budget(history, ["query_id", "kind"], [-F.col("score"), F.col("id")], "tokens", 1500, 5)
    both = passages_.unionByName(records_).drop("used")
    trimmed = folds.fit_budget(both, ["query_id"], [F.col("kind"), -F.col("score"), F.col("id")], "tokens", 2300, stop=True)
    return q.select("query_id").join(trimmed, "query_id", "left").withColumn("reason", F.when(F.col("id").isNull(), "nothing the questions' words cover").otherwise("served"))


@query()
def i32_hash_vectors(spark, d):
    r = records(spark, d, "what")
    return r.select("record_id", embedding.embed("what").alias("v")).select("record_id", F.size("v").alias("dims"), F.round(scores.dot(F.col("v"), F.col("v")), 4).alias("square"))


@query(f"""WITH {C}, {D} SELECT query_id, project_key FROM (SELECT q.query_id, p.project_key, count(*) AS shared, any_value(len(p.words)) AS n FROM (SELECT DISTINCT item_id AS query_id, unnest({_TERMS}) AS term FROM eval_items) q
JOIN (SELECT project_key, words, unnest(words) AS term FROM (SELECT DISTINCT project_key, list_distinct(list_filter(regexp_split_to_array(project_key, '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2)) AS words FROM d WHERE project_key IS NOT NULL)) p USING (term) GROUP BY 1, 2) WHERE shared >= 2 OR (shared = 1 AND n <= 2)""")
def k2_named_projects(spark, d):
    keys = source_documents(spark, d).select("project_key").where("project_key is not null").distinct()
    return retrieval.named_projects(retrieval.query_terms(questions(spark, d)), keys)
