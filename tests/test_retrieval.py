"""Searches on small inputs, by hand."""

import datetime as dt
import math

from pyspark.sql import functions as F

from cairn.functions.embedding import hash_vector
from cairn.operators import chunking, reflection, retrieval, vectors
from cairn.plans import queries_retrieval


def test_explore_takes_words_and_meaning_below_the_strict_bar(spark):
    words = spark.createDataFrame([(1, c, 20.0 - c, c) for c in range(1, 11)], "query_id bigint, chunk_id bigint, bm25 double, rank int")
    near = [(1, 1, 0.99), *((1, c, 0.9 - c / 1000) for c in range(11, 31)), (1, 40, 0.59)]
    meaning = spark.createDataFrame(near, "query_id bigint, chunk_id bigint, similarity double")
    documents = {1: "a", 2: "a", 3: "a", 11: "a", 12: "b", 13: "b", 14: "b"}  # the others have one of their own
    places = spark.createDataFrame([(c, documents.get(c, f"d{c}")) for c in range(1, 41)], "chunk_id bigint, uri string")
    got = [(r.chunk_id, r.via) for r in retrieval.explore(words, meaning, places).orderBy("rank").collect()]
    assert got == [(c, "words") for c in (1, 2, 4, 5, 6, 7, 8)] + [(c, "meaning") for c in (12, 13, 15, 16, 17, 18, 19, 20, 21)]


def test_explore_keeps_common_words(spark):
    terms = spark.createDataFrame([(1, "pump", 0), (1, "zebra", 1)], "query_id bigint, term string, pos int")
    passages = spark.createDataFrame([(i, "", "the pump runs" if i < 250 else "nothing said here") for i in range(300)], "chunk_id bigint, heading string, text string")
    posted, size = retrieval.index(passages, terms)
    assert retrieval.weights(terms, posted, size).where("term = 'pump'").count() == 0
    assert retrieval.search(retrieval.frequencies(terms, posted), posted, size, 8).count() == 8


def test_explore_query_shows_more_than_served_evidence(spark, small):
    got = queries_retrieval.k5_explore(spark, small).toPandas()
    assert got[got.via == "words"].groupby("query_id").size().max() == 8
    assert got.groupby("query_id").size().max() <= 16


RECORDS = "record_id bigint, project_id bigint, record_type string, what string, why string, outcome string, rejected_alternatives array<string>, entities array<string>, confidence double, superseded_by bigint, occurred_at timestamp_ntz"
PROJECTS = "project_key string, project_id bigint, dependencies array<string>, frameworks array<string>, languages array<string>"
AT = dt.datetime(2025, 1, 1)


def test_ranked_memory_counts_entities_and_serves_by_rank(spark):
    row = lambda i, what, entities, confidence=1.0, by=None, rejected=(), project=1: (i, project, "decision", what, None, None, list(rejected), entities, confidence, by, AT)
    records = spark.createDataFrame(
        [
            row(1, "moved the cache to disk", []),  # 2 of 4 words: 0.5 * 0.45 is below the floor
            row(2, "nothing alike", ["Postgres", "class-weights", "pandas"]),  # two entities, no word: 0.6 * 0.45 * 1.15
            row(3, "cache, disk, psql, class", ["postgres"]),  # all words and an entity: capped at 1
            row(4, "cache disk psql class", [], 0.5),
            row(5, "cache disk psql class", [], 1.0, 3),
            row(6, "only psql", ["other"], rejected=["cache on disk", "class"]),  # all words, some in what was rejected
            row(7, "nothing alike", ["postgres"]),
        ],
        RECORDS,
    )
    projects = spark.createDataFrame([("a", 1, [], [], [])], PROJECTS)
    queries = spark.createDataFrame([(1, "psql class cache disk", "a"), (2, "PG class weights", "a")], "query_id bigint, prompt string, project_key string")
    got = {(r.query_id, r.record_id): r.score for r in retrieval.search_memory(queries, records, projects, F.lit(AT)).collect()}
    assert got == {(1, 3): 0.5175, (1, 6): 0.45, (2, 2): 0.3105, (2, 3): 0.414}
    assert retrieval.search_memory(queries, records, projects, F.lit(AT), ["research"]).count() == 0
    assert retrieval.search_memory(queries, records, projects, F.lit(AT), limit=1).count() == 2


def test_records_below_the_coverage_floor_take_no_part(spark):
    row = lambda i, what, entities=(), rejected=(): (i, 1, "decision", what, None, None, list(rejected), list(entities), 1.0, None, AT)
    records = spark.createDataFrame([row(1, "common words"), row(2, "common zorp"), row(3, "common"), row(4, "nothing", ["Quill-State"]), row(5, "nothing", rejected=["flume"])], RECORDS)
    queries = spark.createDataFrame([(1, "common zorp flume quill unseen words absent missing lacking never", None)], "query_id bigint, prompt string, project_key string")
    pool = spark.createDataFrame([(1, i, []) for i in range(1, 6)], "query_id bigint, record_id bigint, named array<string>")
    covered = retrieval.record_coverage(queries, pool, records)
    idf = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    whole = idf(3) + 4 * idf(1) + 5 * idf(0)  # zorp, flume, quill (a part of a name is a token of its own) and words occur once
    got = {r.record_id: r.coverage for r in covered.collect()}
    assert got.keys() == {1, 2, 3, 4, 5}
    for record, held in {1: idf(3) + idf(1), 2: idf(3) + idf(1), 3: idf(3), 4: idf(1), 5: idf(1)}.items():
        assert abs(got[record] - held / whole) < 1e-9
    assert got[3] < 0.07 < got[4]
    vector = spark.createDataFrame([(1, 1, 0.0)], "query_id bigint, record_id bigint, similarity double")
    lexical = retrieval.record_bm25(queries, pool, records)
    fused = {r.record_id for r in retrieval.fuse(lexical, vector, covered).collect()}
    assert {r.record_id for r in lexical.collect()} == {1, 2, 3, 4, 5} and fused == {1, 2, 4, 5}


def test_by_meaning_wants_a_distinctive_word_and_no_near_duplicates(spark):
    same = "zorp alpha beta gamma delta epsilon zeta eta"
    texts = {1: same, 2: same + " theta", 3: "the pump is off topic", 4: "of another zorps kind", 5: "in its title", 6: "zorp below the margin", 7: "zorp and third passage of this document", 8: "zorp, a fourth one here"}
    passages = spark.createDataFrame([(c, "", t) for c, t in texts.items()] + [(c, "", "a pump") for c in range(20, 80)], "chunk_id bigint, heading string, text string")
    places = spark.createDataFrame([(c, "d" if c in (1, 4, 7, 8) else f"u{c}", "on zorp" if c == 5 else "title", "key") for c in [*texts, *range(20, 80)]], "chunk_id bigint, uri string, title string, project_key string")
    similar = spark.createDataFrame([(1, c, s) for c, s in ((1, 0.90), (2, 0.895), (3, 0.89), (4, 0.88), (5, 0.87), (7, 0.865), (8, 0.86), (6, 0.84))], "query_id bigint, chunk_id bigint, similarity double")
    terms = spark.createDataFrame([(1, "pump", 0), (1, "zorp", 1), (1, "unheard", 2)], "query_id bigint, term string, pos int")
    posted, size = retrieval.index(passages.where("chunk_id not in (6, 7, 8)"), terms)
    rare = retrieval.distinctive(terms, posted, size)
    assert [r.term for r in rare.collect()] == ["zorp"]
    found = lambda **more: [r.chunk_id for r in retrieval.by_meaning(similar, rare, passages, places, **more).orderBy("rank").collect()]
    assert found() == [1, 4, 5]
    assert found(taken=spark.createDataFrame([(1, 1)], "query_id bigint, chunk_id bigint")) == [2, 4, 5, 7]


def test_evidence_is_filled_up_by_meaning(spark):
    served = spark.createDataFrame([(1, 10, 0.7), (1, 11, 0.9), (1, 12, 0.8)], "query_id bigint, chunk_id bigint, score double")
    near = spark.createDataFrame([(1, 20, 0.5, 1), (1, 21, 0.4, 2), (2, 30, 0.6, 1)], "query_id bigint, chunk_id bigint, similarity double, rank int")
    got = [(r.query_id, r.chunk_id, r.via) for r in retrieval.filled(served, near).orderBy("query_id", "rank").collect()]
    assert got == [(1, 11, "words"), (1, 12, "words"), (1, 10, "words"), (1, 20, "meaning"), (2, 30, "meaning")]


def test_excerpts(spark):
    many = "\n".join("pump and valve" if i in (20, 25) else f"line {i}" for i in range(30))
    long = "\n".join(["pump " + "x" * 395, "y" * 400, "z" * 400])
    df = spark.createDataFrame([(1, "short\ntext", 5, 6), (2, many, 101, 130), (3, long, None, None), (4, "q" * 1200, 7, 7)], "i int, t string, a int, b int")
    shown = df.select("i", chunking.excerpt(F.col("t"), F.col("a"), F.col("b"), F.array(F.lit("pump"), F.lit("valve"))).alias("x")).select("i", "x.*")
    got = {r.i: (r.excerpt, r.start, r.end) for r in shown.collect()}
    assert got[1] == ("short\ntext", 5, 6)
    assert got[2] == ("\n".join(many.split("\n")[14:26]), 115, 126)
    assert got[3] == ("\n".join(long.split("\n")[:2]), 0, 0)
    assert got[4] == ("q" * 1200, 7, 7)


def test_proposals(spark):
    found = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "statement_id int, record_id int")
    statements = spark.createDataFrame([(1, 0.6, ["old", "d"]), (2, 1.0, ["x"])], "statement_id int, confidence double, entities array<string>")
    records = spark.createDataFrame([(1, 7, ["d", "c", "b"]), (2, 7, ["b", "a", "old"]), (3, 8, ["e", "b"]), (4, 9, ["x"])], "record_id int, project_id int, entities array<string>")
    got = {r.statement_id: (r.winners, r.n, r.projects, r.impact) for r in reflection.proposals(found, statements, records).collect()}
    assert got == {1: (["b", "a", "c"], 3, 2, 0.77), 2: ([], 1, 1, 0.75)}


def widest_plan(monkeypatch, query, spark, d):
    """The most exchanges that any one plan of a query has, written tables and result."""
    widths = []

    def planned(df):
        widths.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return df

    real = retrieval.durable
    for module in (queries_retrieval, retrieval):
        monkeypatch.setattr(module, "durable", lambda df, name="table": real(planned(df), name))
    planned(query(spark, d))
    return max(widths)


def test_record_search_is_planned_in_pieces(spark, small, monkeypatch):
    assert widest_plan(monkeypatch, queries_retrieval.k6_hybrid_records, spark, small) <= 20


def test_context_is_planned_in_pieces(spark, small, monkeypatch):
    assert widest_plan(monkeypatch, queries_retrieval.k12_context, spark, small) <= 25


def test_all_records_the_gate_lets_through_are_in_the_pool(spark):
    at = lambda i: AT - dt.timedelta(days=i)
    row = lambda i, kind="decision", entities=("other",), confidence=1.0, by=None: (i, 1, kind, "said", None, None, [], list(entities), confidence, by, at(i))
    newer = [row(i) for i in range(600)]
    older = [row(600, entities=["Zorp", "ZORP", "Quill"]), row(601, "failure", ["zorp"]), row(602, entities=["zorp"], confidence=0.5), row(603, entities=["zorp"], by=1), row(604, "failure", ["lone"]), row(605, entities=[])]
    records = spark.createDataFrame(newer + older, RECORDS)
    asked = [(1, "implement", ["decision"], ["zorp", "quill"]), (2, "implement", ["decision"], ["lone"]), (3, "debug", ["decision"], ["lone"]), (4, "implement", ["failure", "decision"], ["zorp"]), (5, "implement", ["decision"], [])]
    queries = spark.createDataFrame(asked, "query_id bigint, task string, record_types array<string>, entities array<string>")
    got = {}
    for r in retrieval.record_pool(queries, records).collect():
        got.setdefault(r.query_id, {})[r.record_id] = r.named
    everything = {i: [] for i in [*range(601), 605]}
    assert got == {1: {600: ["quill", "zorp"]}, 3: everything, 4: {600: ["zorp"], 601: ["zorp"]}, 5: everything}


def test_similarity_of_the_pairs_of_a_pool_only(spark):
    questions = spark.createDataFrame([(i, f"the pump {i} leaks") for i in range(5)] + [(5, None)], "query_id bigint, prompt string")
    records = spark.createDataFrame([(i, f"pump {i % 7} was sealed") for i in range(40)], "record_id bigint, text string")
    pairs = [(q, r) for q in range(6) for r in range(40) if r % (q + 1) == 0 and r != 39]
    pool = spark.createDataFrame(pairs, "query_id bigint, record_id bigint")
    want = {(q, r): round(float(hash_vector(f"the pump {q} leaks" if q < 5 else "").astype(float) @ hash_vector(f"pump {r % 7} was sealed").astype(float)), 6) for q, r in pairs}
    for block in (2000, 2):
        got = {(x.query_id, x.record_id): x.similarity for x in vectors.similar_records(questions, records, pool, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
