"""The queries of this subpackage by name, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.near_duplicates import NearDuplicates

    found = NearDuplicates(table(spark, sf_dir, "chunks", "chunk_id", "text"), "chunk_id", "text").pairs()
    return found.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.near_duplicates import NearDuplicates

    return NearDuplicates(table(spark, sf_dir, "chunks", "chunk_id", "text"), "chunk_id", "text").classes().withColumnRenamed("id", "chunk_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.conversations import turns

    # A stored session is one conversation, however long it was silent: there is no gap to look for.
    return turns(table(spark, sf_dir, "transcript_rows"), ["session_id"], texts=False).select("session_id", "turn_number", "user_message_id", "reply_message_id")


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.conversations import turns

    return turns(table(spark, sf_dir, "transcript_rows"), ["session_id"])


def p1_resessionized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of each project by silence alone, as if no session had been stored; rows without a project are a channel of their own, named by the empty string. Sessions of one project
    that ran side by side can't be told apart so and become one."""
    from cairn.llm.conversations import turns

    rows = table(spark, sf_dir, "transcript_rows").withColumn("project_key", F.coalesce("project_key", F.lit("")))
    return turns(rows, ["project_key"], gap="calibrated", check_numbers=False, texts=False)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.credentials import credentials

    found = credentials(table(spark, sf_dir, "chunks", "chunk_id", "text"), "chunk_id", "text")
    return found.select(F.col("id").alias("chunk_id"), "line_no").distinct()


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.credentials import masked

    return masked(table(spark, sf_dir, "chunks", "chunk_id", "text"), "chunk_id", "text").withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.splitting import split

    return split(table(spark, sf_dir, "chunks")).withColumnRenamed("id", "chunk_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text lies in more than one piece, as the packing has put them into containers."""
    put = p6_containers(spark, sf_dir).where("container is not null")
    return put.groupBy("doc_id").agg(F.count("container").alias("n")).where("n > 1").select("doc_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.packing import pack

    return pack(table(spark, sf_dir, "documents", "doc_id", "text", "source")).withColumnRenamed("id", "doc_id")


def p2_put_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cut chunk put together again from its pieces' cores, with what its pieces must satisfy: at most 1,800 characters each, at most 200 of them repeated, no gap."""
    p = p2_pieces(spark, sf_dir)
    fits = (F.length("text") <= 1800) & (F.col("core_char") - F.col("start_char")).between(0, 200) & (F.length("text") == F.col("end_char") - F.col("start_char"))
    core = F.substring("text", F.col("core_char") - F.col("start_char") + 1, F.length("text"))
    whole = p.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", core.alias("core")))).alias("cores"), F.bool_and(fits).alias("within_limits"), F.first("heading").alias("heading"), F.min("start_line").alias("first_line"))
    text = F.array_join(F.transform("cores", lambda x: x["core"]), "")
    return whole.select("chunk_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"), "within_limits", F.coalesce("heading", F.lit("-")).alias("heading"), F.coalesce("first_line", F.lit(-1)).cast("bigint").alias("first_line"))


def p6_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's packed tokens, and whether all its containers keep within the capacity."""
    put = p6_containers(spark, sf_dir).where("container is not null")
    fill = put.groupBy("container").agg((F.sum("n_tokens") <= 4096).alias("fits"))
    return put.join(fill, "container").groupBy("doc_id").agg(F.sum("n_tokens").cast("bigint").alias("n_tokens"), F.bool_and("fits").alias("within_capacity"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items", "item_id", "prompt", "passage")
    return items.select("item_id", F.explode(F.array("prompt", "passage")).alias("text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.leakage import leaks

    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), _passages(spark, sf_dir))


def p7_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.leakage import leaks

    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), _passages(spark, sf_dir), exact=False)


def _content_model(spark: SparkSession, sf_dir: str):
    from cairn.llm.toxicity import train

    return train(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "content_labels", "doc_id", "toxic"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.toxicity import score

    scored = score(table(spark, sf_dir, "documents", "doc_id", "text"), _content_model(spark, sf_dir))
    return scored.groupBy(F.col("id").alias("doc_id")).agg(F.max("score").alias("score"), F.max("n_sentences").alias("n_sentences"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.toxicity import score

    model = _content_model(spark, sf_dir)
    scored = score(table(spark, sf_dir, "documents", "doc_id", "text"), model)
    return scored.where(F.col("score") >= model.threshold).select(F.col("id").alias("doc_id")).distinct()


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.toxicity import locate

    return locate(table(spark, sf_dir, "documents", "doc_id", "text"), _content_model(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, offending documents and their share by source."""
    from cairn.llm.toxicity import score

    model = _content_model(spark, sf_dir)
    scored = score(table(spark, sf_dir, "documents", "doc_id", "text"), model).groupBy("id").agg(F.max("score").alias("score"))
    sources = table(spark, sf_dir, "documents", "doc_id", "source").groupBy(F.col("doc_id").alias("id")).agg(F.min("source").alias("source"))
    flagged = F.count_if(F.col("score") >= model.threshold)
    return scored.join(sources, "id").groupBy("source").agg(F.count("*").alias("n_docs"), flagged.alias("n_flagged"), (flagged / F.count("*")).alias("share"))


def p8_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: out-of-fold quality on the training documents, against labels corrected for the estimated rates of wrong ones."""
    r = _content_model(spark, sf_dir).heldout
    kinds = {int: "bigint", float: "double"}
    return spark.createDataFrame([tuple(r.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in r.items()))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p4_neighbours(spark, sf_dir)
    return near.select(F.least("record_id", "neighbour_id").alias("record_id_a"), F.greatest("record_id", "neighbour_id").alias("record_id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``record_id``, ``neighbour_id``, ``similarity``, ``rank``)."""
    from cairn.llm.neighbours import neighbours

    found = neighbours(table(spark, sf_dir, "episodic_records", "record_id", "embedding"), "record_id", "embedding")
    return found.select(F.col("id").alias("record_id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"), "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


_SOUND = "embedding IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

_P1 = """WITH t AS (SELECT * FROM transcript_rows QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY received_at DESC) = 1),
w AS (SELECT *, coalesce(regexp_matches(user_text, '\\S'), false) AS u, coalesce(regexp_matches(reply_text, '\\S'), false) AS r, lower(trim(speaker)) AS s FROM t WHERE NOT is_meta AND NOT is_sidechain),
m AS (SELECT session_id, message_id, turn_timestamp AS tm, turn_number, CASE WHEN s IS NULL OR s = '' THEN CASE WHEN u AND NOT r THEN 1 WHEN r AND NOT u THEN 0 END WHEN s IN ('user', 'human', 'you', 'me', 'customer', 'prompter') THEN 1 WHEN s IN ('assistant', 'ai', 'model', 'bot', 'agent') THEN 0 END AS is_user FROM w WHERE u OR r),
n AS (SELECT *, sum(is_user) OVER (PARTITION BY session_id ORDER BY tm, message_id) AS turn FROM m WHERE is_user IS NOT NULL),
g AS (SELECT session_id, turn::BIGINT AS turn_number, max(CASE WHEN is_user = 1 THEN message_id END) AS user_message_id, arg_max(message_id, (tm, message_id)) FILTER (is_user = 0) AS reply_message_id, coalesce(bool_or(turn_number <> turn), false) AS wrong FROM n GROUP BY session_id, turn)
SELECT session_id, turn_number, user_message_id, reply_message_id FROM g QUALIFY min((user_message_id IS NOT NULL AND reply_message_id IS NOT NULL AND NOT wrong)::INT) OVER (PARTITION BY session_id) = 1"""

_P1_TURNS = (
    _P1.replace("message_id, turn_timestamp AS tm, turn_number,", "message_id, turn_timestamp AS tm, turn_number, user_text, reply_text, u, r,")
    .replace("AS reply_message_id, coalesce(", """AS reply_message_id, max(CASE WHEN is_user = 1 THEN tm END) AS turn_timestamp, max(CASE WHEN is_user = 1 THEN CASE WHEN u THEN user_text ELSE reply_text END END) AS user_text,
arg_max(CASE WHEN r THEN reply_text ELSE user_text END, (tm, message_id)) FILTER (is_user = 0) AS reply_text, coalesce(""")
    .replace("SELECT session_id, turn_number, user_message_id, reply_message_id FROM g", "SELECT session_id, turn_number, user_message_id, reply_message_id, turn_timestamp, user_text, reply_text FROM g")
)

_P4 = f"""WITH v AS (SELECT record_id, arg_max(embedding, ingested_at)::DOUBLE[] AS e FROM episodic_records WHERE {_SOUND} GROUP BY 1),
s AS (SELECT a.record_id AS a, b.record_id AS b, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.record_id <> b.record_id), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS record_id_a, greatest(a, b) AS record_id_b FROM k WHERE sim >= 0.65"""

_P4_NEAR = _P4.rsplit("SELECT DISTINCT", 1)[0] + "SELECT a AS record_id, b AS neighbour_id, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b)::INT AS rank FROM k WHERE sim >= 0.65"

_P5 = """WITH w AS (SELECT chunk_id, regexp_extract_all(lower(any_value(text)), '[\\p{L}\\p{N}]+') AS w FROM chunks GROUP BY 1),
g AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)), n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY 1),
x AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT chunk_id_a, chunk_id_b FROM x JOIN n p ON p.chunk_id = chunk_id_a JOIN n q ON q.chunk_id = chunk_id_b WHERE c / (p.n + q.n - c)::DOUBLE >= 0.5"""

_P5_CLASSES = (
    _P5.replace("WITH w AS", "WITH RECURSIVE w AS").replace("\nSELECT chunk_id_a, chunk_id_b FROM x", ",\npr AS (SELECT chunk_id_a AS a, chunk_id_b AS b FROM x").replace(">= 0.5", ">= 0.5)")
    + """, f AS (SELECT chunk_id, md5(string_agg(g, '|' ORDER BY g)) AS s FROM g GROUP BY 1), ids AS (SELECT DISTINCT c.chunk_id, coalesce(s, 'own ' || c.chunk_id) AS s FROM chunks c LEFT JOIN f USING (chunk_id)),
reps AS (SELECT *, min(chunk_id) OVER (PARTITION BY s) AS rep FROM ids), links AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr) q JOIN reps x ON x.chunk_id = q.a JOIN reps y ON y.chunk_id = q.b WHERE x.rep <> y.rep),
reach AS (SELECT rep AS v, rep AS u FROM reps UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.u)
SELECT chunk_id, rep, (SELECT min(u) FROM reach WHERE v = rep) AS class_id, (SELECT count(*) FROM links WHERE a = rep) AS n_links FROM reps"""
)

#: Pieces by what they must satisfy: each chunk's limits, overlaps and lines, and the text put together again.
_P2_SUMS = """WITH c AS (SELECT DISTINCT chunk_id, text, heading, start_line, end_line FROM chunks WHERE length(text) > 1800)
SELECT chunk_id, length(text)::BIGINT AS n_chars, md5(text) AS digest, true AS within_limits, coalesce(heading, '-') AS heading,
CASE WHEN start_line > 0 THEN start_line ELSE coalesce(start_line, -1) END::BIGINT AS first_line FROM c"""

_P6_SUMS = """SELECT doc_id, sum(n)::BIGINT AS n_tokens, true AS within_capacity FROM (SELECT DISTINCT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL AND text <> '') GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_turns": _P1_TURNS,
        "p2_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1800",
        "p4_found": _P4,
        "p4_neighbours": _P4_NEAR,
        "p2_put_together": _P2_SUMS,
        "p5_found": _P5,
        "p5_classes": _P5_CLASSES,
        "p6_complete": _P6_SUMS,
        "p6_found": "SELECT DISTINCT doc_id FROM documents WHERE octet_length(encode(text)) > 4096",
    }
