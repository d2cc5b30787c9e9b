"""Search over passages and records for batches of questions.

Everything is keyed by ``query_id``: terms, weights, candidates and selections of all questions are computed together. Candidates come from postings of the questions'
terms only, so the passages' text is scanned once and what is shuffled grows with the matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import fixed_values as V
from cairn.functions import scores, text
from cairn.plans.durable import durable


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, pos)."""
    return queries.select("query_id", F.posexplode(text.question_terms("prompt")).alias("pos", "term"))


def postings(passages: DataFrame, terms: DataFrame | None = None, heading_weight: float = 3.0) -> DataFrame:
    """(term, chunk_id, tf, dl): weighted term frequency over heading and text, and the passage's length in tokens; with ``terms``, only those. The empty term has a row for each passage, whose
    ``tf`` is the number of times the passage was delivered. Deliveries of a passage are identical, so frequencies are divided by that number: texts needn't be shuffled to make them distinct."""
    lists = passages.select("chunk_id", F.transform(text.pieces(F.coalesce("heading", F.lit(""))), F.lower).alias("h"), F.transform(text.pieces(F.coalesce("text", F.lit(""))), F.lower).alias("t"))
    row = lambda weight: lambda x: F.struct(x.alias("term"), F.lit(weight).alias("w"))
    mark = F.array(F.struct(F.lit("").alias("term"), F.lit(1.0).alias("w")))
    tokens = lists.select("chunk_id", (F.size("h") + F.size("t")).alias("dl"), F.explode(F.concat(mark, F.transform("h", row(heading_weight)), F.transform("t", row(1.0)))).alias("k"))
    rows = tokens.select("chunk_id", "dl", "k.term", "k.w")
    if terms is not None:
        wanted = terms.select("term").union(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
        rows = rows.join(wanted, "term", "left_semi")
    return rows.groupBy("term", "chunk_id").agg(F.sum("w").alias("tf"), F.first("dl").alias("dl"))


def index(passages: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the given terms, and one row of total and mean_length, from one pass over the text; the postings are a written table, as several steps read them."""
    posted = durable(postings(passages, terms), "postings")
    each = posted.where("term = ''")
    size = each.agg(F.count("*").alias("total"), F.avg("dl").alias("mean_length"))
    again = each.where("tf > 1").select("chunk_id", F.col("tf").alias("times"))
    once = posted.where("term <> ''").join(again, "chunk_id", "left").withColumn("tf", F.col("tf") / F.coalesce("times", F.lit(1.0)))
    return once.select("term", "chunk_id", "tf", "dl"), size


def frequencies(terms: DataFrame, posted: DataFrame) -> DataFrame:
    """(query_id, term, pos, df): the number of passages that have a question's term, common terms included."""
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).select("query_id", "term", "pos", "df")


def weights(terms: DataFrame, posted: DataFrame, size: DataFrame) -> DataFrame:
    """(query_id, term, pos, df, weight): rarity weights; terms too common to tell are left out, unseen ones have df 0."""
    all_ = frequencies(terms, posted).join(F.broadcast(size))  # one row
    return all_.withColumn("weight", scores.term_weight(F.col("total"), F.col("df"))).where("weight is not null").select("query_id", "term", "pos", "df", "weight")


def search(weighted: DataFrame, posted: DataFrame, size: DataFrame, k: int = V.CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, bm25, rank): the k best passages per question, any term counting; ties go to the smaller id."""
    inverse = F.greatest(F.ln((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = inverse * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("mean_length")))
    scored = weighted.where("df > 0").select("query_id", "term", "df").join(posted, "term").join(F.broadcast(size)).groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("bm25"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), "chunk_id"))).where(F.col("rank") <= k)


def named_projects(terms: DataFrame, projects: DataFrame) -> DataFrame:
    """(query_id, project_key): projects whose name the question uses: two words of it, or one if it has only one or two."""
    words = projects.select("project_key", text.name_terms("project_key").alias("words"))
    shared = terms.select("query_id", "term").distinct().join(words.select("project_key", F.size("words").alias("n"), F.explode("words").alias("term")), "term").groupBy("query_id", "project_key").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    return shared.where("shared >= 2 or (shared = 1 and n <= 2)").select("query_id", "project_key")


def coverage(candidates: DataFrame, weighted: DataFrame, passages: DataFrame, places: DataFrame) -> DataFrame:
    """(query_id, chunk_id, uri, project_key, coverage, matched, vocabulary): the share of the question's weight that a passage, its title and its project's name hold, in any inflection.

    Only candidates' texts are read on: they are picked by a semi-join and then made distinct."""
    said = text.vocabulary(F.concat_ws(" ", F.coalesce("heading", F.lit("")), "text"))
    p = passages.select("chunk_id", "heading", "text").join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", said.alias("vocabulary")).dropDuplicates(["chunk_id"])
    placed = F.array_union("vocabulary", F.array_union(text.name_terms(F.coalesce("project_key", F.lit(""))), text.name_terms(F.coalesce("title", F.lit("")))))
    p = durable(p.join(places, "chunk_id").select("chunk_id", "uri", "project_key", "vocabulary", placed.alias("present")), "present")
    # Which term is in which passage: equal words, and inflections, which share their first four letters, by equi-joins.
    words = p.select("chunk_id", F.explode("present").alias("word"))
    terms = weighted.select("term").distinct()
    start = lambda c: F.substring(c, 1, 4)
    inflected = words.where(F.length("word") >= 4).withColumn("start", start("word")).join(terms.where(F.length("term") >= 4).withColumn("start", start("term")), "start").where(text.close(F.col("term"), F.col("word")))
    matched = words.join(terms, words["word"] == terms["term"]).select("term", "chunk_id").union(inflected.select("term", "chunk_id")).distinct().withColumn("hit", F.lit(True))
    pairs = candidates.select("query_id", "chunk_id").join(weighted.select("query_id", "term", "pos", "weight"), "query_id").join(matched, ["term", "chunk_id"], "left")
    hit = F.coalesce("hit", F.lit(False))
    share = F.try_divide(F.sum(F.when(hit, F.col("weight")).otherwise(0.0)), F.sum("weight"))
    found = pairs.groupBy("query_id", "chunk_id").agg(F.round(F.coalesce(share, F.lit(0.0)), 6).alias("coverage"), F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("pos", "term")))), lambda m: m["term"]).alias("matched"))
    return found.join(p.select("chunk_id", "uri", "project_key", "vocabulary"), "chunk_id")


def judge(covered: DataFrame, weighted: DataFrame, queries: DataFrame, named: DataFrame, limit: int = V.MAX_EVIDENCE, floor: float = V.COVERAGE_FLOOR) -> DataFrame:
    """(query_id, chunk_id, score, coverage, outcome, pos): the served passages and why the others were cut.

    A fold over a question's candidates (at most some dozens) in order of score: limit, passages per document and near-duplicates depend on what was served before."""
    anchor = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "pos"))
    present = weighted.where("df > 0").withColumn("n", anchor)
    per_query = present.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= V.ANCHORS, F.col("term")))).alias("anchors"), F.least(F.lit(2), F.count("*")).alias("needed"))
    c = covered.join(named.withColumn("named", F.lit(True)), ["query_id", "project_key"], "left").withColumn("named", F.coalesce("named", F.lit(False)))
    c = c.join(queries.select("query_id", F.col("project_key").alias("asker")), "query_id").join(per_query, "query_id")
    boost = F.when(F.col("named"), V.NAMED_BOOST).otherwise(1.0) * F.when(F.col("asker") == F.col("project_key"), V.SAME_PROJECT_BOOST).otherwise(1.0)
    c = c.withColumn("score", F.round(F.col("coverage") * boost, 6))
    least = F.when(F.col("named"), F.least(F.lit(floor), F.lit(V.NAMED_FLOOR))).otherwise(F.lit(floor))
    early = (
        F.when(F.col("coverage") < least, "cut: below the coverage floor")
        .when(~F.arrays_overlap("anchors", "matched"), "cut: mentions none of the anchors")
        .when(F.size("matched") < F.col("needed"), "cut: too few of the question's terms")
        .otherwise("")
    )
    row = F.struct((-F.col("score")).alias("o"), "chunk_id", F.coalesce("uri", F.lit("")).alias("uri"), "score", "coverage", "vocabulary", early.alias("early"))
    listed = c.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.expr("named_struct('kept', cast(array() as array<struct<uri: string, vocabulary: array<string>>>), 'out', cast(array() as array<string>))")

    def step(acc: Column, x: Column) -> Column:
        kept = acc["kept"]
        outcome = (
            F.when(x["early"] != "", x["early"])
            .when(F.size(kept) >= limit, "cut: over the limit")
            .when(F.size(F.filter(kept, lambda k: k["uri"] == x["uri"])) >= V.PER_DOCUMENT, "cut: this document already contributed")
            .when(F.exists(kept, lambda k: F.size(F.array_intersect(k["vocabulary"], x["vocabulary"])) >= V.NEAR_DUPLICATE * F.size(F.array_union(k["vocabulary"], x["vocabulary"]))), "cut: near-duplicate of a served passage")
            .otherwise("served")
        )
        grown = F.when(outcome == "served", F.concat(kept, F.array(F.struct(x["uri"].alias("uri"), x["vocabulary"].alias("vocabulary"))))).otherwise(kept)
        return F.struct(grown.alias("kept"), F.concat(acc["out"], F.array(outcome)).alias("out"))

    folded = listed.withColumn("out", F.aggregate("rows", start, step, lambda a: a["out"]))
    each = folded.select("query_id", F.posexplode(F.arrays_zip("rows", "out")).alias("pos", "z"))
    return each.select("query_id", F.col("z.rows.chunk_id").alias("chunk_id"), F.col("z.rows.score").alias("score"), F.col("z.rows.coverage").alias("coverage"), F.col("z.out").alias("outcome"), "pos")


def evidence(queries: DataFrame, passages: DataFrame, places: DataFrame, projects: DataFrame, indexed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``passages``: chunk_id, heading, text as delivered; ``places``: chunk_id, uri, title, project_key, distinct. Cited passages for a batch of questions: (query_id, chunk_id, score, coverage, outcome, pos). Questions nothing covers have no served row."""
    terms = query_terms(queries)
    posted, size = indexed or index(passages, terms)
    weighted = durable(weights(terms, posted, size), "weights")
    named = named_projects(terms, projects)
    hits = search(weighted, posted, size).select("query_id", "chunk_id")
    own = posted.join(places.select("chunk_id", "project_key"), "chunk_id").join(named, "project_key").select("query_id", "term", "chunk_id", "tf", "dl", "project_key")
    inverse = F.greatest(F.ln((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = inverse * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("mean_length")))
    in_project = own.join(weighted.select("query_id", "term", "df"), ["query_id", "term"]).join(F.broadcast(size)).groupBy("query_id", "project_key", "chunk_id").agg(F.sum(part).alias("bm25"))
    ranked = in_project.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "project_key").orderBy(F.desc("bm25"), "chunk_id"))).where(F.col("rank") <= V.PROJECT_CANDIDATES)
    candidates = durable(hits.union(ranked.select("query_id", "chunk_id")).distinct(), "candidates")
    covered = durable(coverage(candidates, weighted, passages, places), "covered")
    return judge(covered, weighted, queries, named)


def distinctive(terms: DataFrame, posted: DataFrame, size: DataFrame) -> DataFrame:
    """(query_id, term, pos, weight): the terms of a question that some passages have, but few; all weigh 1."""
    few = F.greatest(F.col("total") * V.RARE_SHARE, F.lit(float(V.RARE_MIN)))
    return frequencies(terms, posted).join(F.broadcast(size)).where((F.col("df") > 0) & (F.col("df") <= few)).select("query_id", "term", "pos", F.lit(1.0).alias("weight"))


def by_meaning(similar: DataFrame, rare: DataFrame, passages: DataFrame, places: DataFrame, taken: DataFrame | None = None, threshold: float = 0.80, margin: float = 0.05, candidates: int = 12) -> DataFrame:
    """(query_id, chunk_id, uri, similarity, rank): of (query_id, chunk_id, similarity) the nearest that reach the threshold, lie within a margin of the best and hold one of the question's
    ``rare`` terms, at most two a document and none that nearly repeats a better one. ``taken`` (query_id, chunk_id) are passed over, but the best of all sets the margin.

    A fold over a question's candidates (at most ``candidates``), as in ``judge``."""
    top = similar.select("query_id", "chunk_id", "similarity").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))).where(F.col("n") <= candidates)
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    near = top.withColumn("best", best).where((F.col("similarity") >= threshold) & (F.col("similarity") >= F.col("best") - margin)).drop("n", "best")
    if taken is not None:
        near = near.join(taken.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    near = durable(near, "near")
    sharing = coverage(near, rare, passages, places).where(F.size("matched") > 0).select("query_id", "chunk_id", "uri", "vocabulary").join(near, ["query_id", "chunk_id"])
    row = F.struct((-F.col("similarity")).alias("o"), "chunk_id", F.coalesce("uri", F.lit("")).alias("uri"), "similarity", "vocabulary")
    listed = sharing.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.expr("cast(array() as array<struct<chunk_id: bigint, uri: string, similarity: double, vocabulary: array<string>>>)")

    def step(kept: Column, x: Column) -> Column:
        full = F.size(F.filter(kept, lambda k: k["uri"] == x["uri"])) >= V.PER_DOCUMENT
        again = F.exists(kept, lambda k: F.size(F.array_intersect(k["vocabulary"], x["vocabulary"])) >= V.NEAR_DUPLICATE * F.size(F.array_union(k["vocabulary"], x["vocabulary"])))
        return F.when(full | again, kept).otherwise(F.concat(kept, F.array(F.struct(*(x[c].alias(c) for c in ("chunk_id", "uri", "similarity", "vocabulary"))))))

    each = listed.select("query_id", F.posexplode(F.aggregate("rows", start, step)).alias("pos", "k"))
    return each.select("query_id", F.col("k.chunk_id").alias("chunk_id"), F.col("k.uri").alias("uri"), F.col("k.similarity").alias("similarity"), (F.col("pos") + 1).alias("rank"))


def filled(served: DataFrame, near: DataFrame, limit: int = V.MAX_EVIDENCE) -> DataFrame:
    """(query_id, chunk_id, via, value, rank): served (query_id, chunk_id, score) first, then of (query_id, chunk_id, similarity, rank) as many as there is room for."""
    words = served.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).select("query_id", "chunk_id", F.lit("words").alias("via"), F.col("score").alias("value"), "rank")
    n = words.groupBy("query_id").agg(F.count("*").alias("n"))
    means = near.join(n, "query_id", "left").withColumn("rank", F.col("rank") + F.coalesce("n", F.lit(0))).where(F.col("rank") <= limit)
    return words.unionByName(means.select("query_id", "chunk_id", F.lit("meaning").alias("via"), F.col("similarity").alias("value"), F.col("rank").cast("int").alias("rank")))


def explore(words: DataFrame, meaning: DataFrame, places: DataFrame, limit: int = 8, floor: float = 0.6) -> DataFrame:
    """Explicit search: the first ``limit`` of (query_id, chunk_id, bm25, rank), then what (query_id, chunk_id, similarity) has at or above the floor, at most two passages a document over
    both and twice the limit in all; ``via`` says which. Nothing is held to the bar of served evidence."""
    said = words.where(F.col("rank") <= limit).select("query_id", "chunk_id", F.lit("words").alias("via"), F.col("bm25").alias("value"))
    means = meaning.where(F.col("similarity") >= floor).join(said, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.lit("meaning").alias("via"), F.col("similarity").alias("value"))
    both = said.unionByName(means).join(places.select("chunk_id", "uri"), "chunk_id")
    order = (F.desc("via"), F.desc("value"), "chunk_id")
    few = both.withColumn("in_document", F.row_number().over(Window.partitionBy("query_id", "uri").orderBy(*order))).where(F.col("in_document") <= V.PER_DOCUMENT)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= 2 * limit).select("query_id", "chunk_id", "via", "value", "rank")


def record_pool(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, record_id, named): what the gate lets a question see.

    ``queries``: query_id, task, record_types, entities; ``records``: record_id, record_type, confidence, superseded_by, entities. All records of a question's types that have one of its
    entities, by an equi-join on the entity; if none has, or it names none, all of these types, for named entities only in three tasks. All are looked at, not only the newest 500 as in the reference."""
    serving = records.where((F.col("confidence") >= V.SERVE_CONFIDENCE) & F.col("superseded_by").isNull())
    lowered = F.array_distinct(F.transform("entities", F.lower))
    asked = queries.select("query_id", "task", F.explode(F.array_distinct("record_types")).alias("record_type"), lowered.alias("asked"))
    has = serving.select("record_id", "record_type", F.explode(lowered).alias("entity"))
    met = has.join(asked.select("query_id", "record_type", F.explode("asked").alias("entity")), ["record_type", "entity"])
    named = durable(met.groupBy("query_id", "record_id").agg(F.array_sort(F.collect_list("entity")).alias("named")), "named")
    widened = asked.where((F.size("asked") == 0) | F.col("task").isin("architect", "explore", "debug")).join(named.select("query_id").distinct(), "query_id", "left_anti")
    whole = serving.select("record_id", "record_type").join(widened, "record_type").select("query_id", "record_id", F.array().cast("array<string>").alias("named"))
    return named.unionByName(whole)


def _record_bag() -> Column:
    """A record's tokens: its texts and rejected alternatives, each entity's whole forms and parts three times, its type."""
    forms = lambda e: F.array_distinct(F.concat(text.record_tokens(e), F.filter(F.split(F.lower(e), r"[-_.]"), lambda p: F.length(p) > 1)))
    entities = F.flatten(F.transform(F.coalesce("entities", F.array().cast("array<string>")), forms))
    return F.concat(text.record_tokens(F.concat_ws(" ", "what", "why", "outcome", "rejected_alternatives")), F.flatten(F.array_repeat(entities, 3)), F.array(F.lower("record_type")))


def record_coverage(queries: DataFrame, pool: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, record_id, coverage): the share of a question's terms, by rarity within its own pool, that a record holds, whole or as a part of a name; records that hold none have no row."""
    asked = query_terms(queries).select("query_id", "term")
    tokens = records.select("record_id", F.array_distinct(_record_bag()).alias("tokens"))
    # Records meet those who may see them before questions' terms do: what is shuffled is pairs and records, not pairs times terms.
    seen = pool.select("query_id", "record_id").join(tokens, "record_id")
    df = seen.select("query_id", F.explode("tokens").alias("term")).join(asked, ["query_id", "term"]).groupBy("query_id", "term").agg(F.count("*").alias("df"))
    sizes = pool.groupBy("query_id").agg(F.count("*").alias("total"))
    weighted = asked.join(sizes, "query_id").join(df, ["query_id", "term"], "left").select("query_id", "term", scores.idf(F.col("total"), F.coalesce("df", F.lit(0))).alias("weight"))
    words = F.array_distinct(F.concat("tokens", F.flatten(F.transform("tokens", lambda t: F.split(t, r"[-_.]")))))
    held = seen.select("query_id", "record_id", F.explode(words).alias("term")).join(weighted, ["query_id", "term"]).groupBy("query_id", "record_id").agg(F.sum("weight").alias("held"))
    whole = weighted.groupBy("query_id").agg(F.sum("weight").alias("whole"))
    return held.join(whole, "query_id").select("query_id", "record_id", (F.col("held") / F.col("whole")).alias("coverage"))


def record_bm25(queries: DataFrame, pool: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, record_id, lexical): BM25 within each question's own pool, entity tokens counting three times, the type once, divided by the best.

    Question tokens are not made distinct: a word asked twice counts twice."""
    bags = records.select("record_id", _record_bag().alias("tokens"))
    sizes = bags.select("record_id", F.size("tokens").alias("dl"))
    tf = bags.select("record_id", F.explode("tokens").alias("term")).groupBy("record_id", "term").agg(F.count("*").alias("tf"))
    stats = pool.join(sizes, "record_id").groupBy("query_id").agg(F.count("*").alias("total"), F.avg("dl").alias("mean_length"))
    asked = queries.select("query_id", F.explode(text.record_tokens("prompt")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    met = pool.select("query_id", "record_id").join(tf, "record_id").join(asked, ["query_id", "term"])
    df = met.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    part = F.col("times") * scores.bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("total"), F.col("mean_length"))
    total = met.join(df, ["query_id", "term"]).join(sizes, "record_id").join(stats, "query_id").groupBy("query_id", "record_id").agg(F.sum(part).alias("bm25")).where("bm25 > 0")
    return total.withColumn("lexical", F.col("bm25") / F.max("bm25").over(Window.partitionBy("query_id"))).drop("bm25")


def fuse(lexical: DataFrame, vector: DataFrame, covered: DataFrame) -> DataFrame:
    """(query_id, record_id, relevance): the two rankings blended. Of the best by words only those stay that cover enough of the question, and take their place among what is left; vectors have
    their floor before they are divided by their best."""
    by = lambda c: Window.partitionBy("query_id").orderBy(F.desc(c), "record_id")
    best = lexical.withColumn("lp", F.row_number().over(by("lexical"))).where(F.col("lp") <= V.PER_RETRIEVER)
    above = covered.where(F.col("coverage") >= V.RECORD_COVERAGE_FLOOR).select("query_id", "record_id")
    lex = best.join(above, ["query_id", "record_id"], "left_semi").withColumn("lp", F.row_number().over(by("lexical")))
    vec = vector.where(F.col("similarity") >= V.MIN_SIMILARITY).withColumn("vp", F.row_number().over(by("similarity"))).where(F.col("vp") <= V.PER_RETRIEVER)
    vec = vec.withColumn("vector", F.col("similarity") / F.max("similarity").over(Window.partitionBy("query_id")))
    both = lex.join(vec, ["query_id", "record_id"], "full_outer")
    rrf = F.coalesce(V.LEXICAL_WEIGHT / (V.RRF_K + F.col("lp")), F.lit(0.0)) + F.coalesce(V.VECTOR_WEIGHT / (V.RRF_K + F.col("vp")), F.lit(0.0))
    both = both.withColumn("rrf", rrf)
    whole = Window.partitionBy("query_id")
    blend = V.LEXICAL_WEIGHT * F.coalesce("lexical", F.lit(0.0)) + V.VECTOR_WEIGHT * F.coalesce("vector", F.lit(0.0)) + V.TIE_WEIGHT * F.col("rrf") / F.max("rrf").over(whole)
    both = both.withColumn("blend", blend)
    return both.select("query_id", "record_id", F.least(F.lit(1.0), F.col("blend") / F.max("blend").over(whole)).alias("relevance"))


def rank_records(fused: DataFrame, pool: DataFrame, queries: DataFrame, records: DataFrame, projects: DataFrame, now: Column, limit: int = V.MAX_STATEMENTS, least: float = V.MIN_SCORE, share: float = V.RELATIVE_FLOOR) -> DataFrame:
    """(query_id, record_id, score, rank): scored, cut at the absolute floor, then at a share of the best, then at the limit."""
    caller = projects.select(F.col("project_key").alias("asker"), F.col("project_id").alias("asker_id"), *(text.clean_set(c).alias(f"{c}_a") for c in ("dependencies", "frameworks", "languages")))
    own = projects.select("project_id", *(text.clean_set(c).alias(f"{c}_b") for c in ("dependencies", "frameworks", "languages")))
    x = fused.join(pool, ["query_id", "record_id"]).join(queries.select("query_id", F.col("project_key").alias("asker")), "query_id")
    x = x.join(records.select("record_id", "project_id", "confidence", "occurred_at"), "record_id").join(caller, "asker", "left").join(own, "project_id", "left")
    alike = scores.fingerprint_similarity([(w, F.coalesce(F.col(f"{c}_a"), F.array().cast("array<string>")), F.coalesce(F.col(f"{c}_b"), F.array().cast("array<string>"))) for w, c in ((0.5, "dependencies"), (0.25, "frameworks"), (0.15, "languages"))])
    alike = F.when(F.col("asker_id").isNotNull(), alike).otherwise(0.0)
    foreign = F.coalesce(F.col("asker_id") != F.col("project_id"), F.lit(False))
    score = scores.rank_score(F.col("confidence"), F.col("relevance"), scores.recency(F.col("occurred_at"), now), alike, foreign, F.size("named") > 0)
    above = x.withColumn("score", score).where(F.col("score") >= least).withColumn("best", F.max("score").over(Window.partitionBy("query_id"))).where(F.col("score") >= share * F.col("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("occurred_at"), "record_id")
    return above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "record_id", "score", "rank")


def _word_hits(queries: DataFrame, records: DataFrame, said: Column) -> DataFrame:
    """(query_id, record_id, hits, n_words): how many of a question's longer words occur in a record, also within other words."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("prompt"), r"\s+"), lambda w: F.length(w) > 2))).alias("word"))
    n_words = words.groupBy("query_id").agg(F.count("*").alias("n_words"))
    # The questions' distinct words are a stated set, held against all records in blocks of a counted size: one pass of an automaton over a record's text finds all words of a block.
    once = durable(words.select("word").distinct(), "words")
    blocks = max(1, -(-once.count() // WORD_BLOCK))
    texts = records.select("record_id", F.lower(said).alias("said"))
    hits = None
    for n in range(blocks):
        wanted = [r.word for r in once.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == n).collect()]

        def run(batches: Iterator[pd.DataFrame], wanted=wanted) -> Iterator[pd.DataFrame]:
            find = _finder(wanted)
            for batch in batches:
                rows = [(i, w) for i, t in zip(batch.record_id, batch.said) if t for w in find(t)]
                yield pd.DataFrame(rows, columns=["record_id", "word"])

        found = texts.mapInPandas(run, "record_id bigint, word string")
        hits = found if hits is None else hits.unionByName(found)
    return words.join(hits, "word").groupBy("query_id", "record_id").agg(F.count("*").alias("hits")).join(n_words, "query_id")


#: Words that one automaton holds, some MB.
WORD_BLOCK = 50_000


def _finder(words: list[str]) -> Callable[[str], set[str]]:
    """The words of a list that occur anywhere in a text."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {w for w in words if w in text}
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    if not words:
        return lambda text: set()
    automaton.make_automaton()
    return lambda text: {w for _, w in automaton.iter(text)}


def word_share(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, record_id, score): the share of a question's longer words that occur anywhere in a record, also within other words."""
    said = F.concat_ws(" ", "what", "why", "outcome", F.array_join("entities", " "))
    return _word_hits(queries, records, said).select("query_id", "record_id", F.round(F.col("hits") / F.col("n_words"), 6).alias("score"))


def search_memory(queries: DataFrame, records: DataFrame, projects: DataFrame, now: Column, types: list[str] | None = None, limit: int = 10) -> DataFrame:
    """(query_id, record_id, score, rank): explicit search of the records that may be served. Relevance is the share of words plus 0.3 for each entity of the record that the question
    names, 1 at most; a record with either stands. Ranked, cut at ``BASELINE_SCORE`` and the limit. All such records are looked at, not only the newest 400 as in the reference."""
    serving = records.where((F.col("confidence") >= V.SERVE_CONFIDENCE) & F.col("superseded_by").isNull())
    if types:
        serving = serving.where(F.col("record_type").isin(types))
    words = _word_hits(queries, serving, F.concat_ws(" ", "what", "why", "outcome", "rejected_alternatives"))
    has = serving.select("record_id", F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("entity"))
    known = has.select(text.normal_entity(F.col("entity")).alias("entity")).distinct()
    asked = queries.select("query_id", F.explode(F.transform(text.candidate_terms("prompt"), text.normal_entity)).alias("entity")).distinct().join(known, "entity", "left_semi")
    named = asked.join(has, "entity").groupBy("query_id", "record_id").agg(F.array_sort(F.collect_set("entity")).alias("named"))
    both = words.join(named, ["query_id", "record_id"], "full_outer").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
    relevance = F.least(F.lit(1.0), F.coalesce(F.col("hits") / F.col("n_words"), F.lit(0.0)) + V.NAMED_RELEVANCE * F.size("named"))
    found = both.select("query_id", "record_id", "named", relevance.alias("relevance"))
    return rank_records(found.drop("named"), found.drop("relevance"), queries, serving, projects, now, limit, V.BASELINE_SCORE, 0.0)
