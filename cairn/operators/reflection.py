"""What later records say about standing statements: contradictions, support, time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import scores, text

#: Where the text of an abandonment stops being about what was abandoned; tried in this order.
PIVOTS = (" in favour of ", " in favor of ", " instead of ", "; ", " rather than ", " for ", " after ", " when ", " where ", " on ", " because ")


def subject(statement: Column, category: Column, entities: Column) -> Column:
    """The entities a statement is about: those its text names, of an abandonment those named before the text turns to the replacement; all if it names none."""
    whole = F.lower(statement)
    after = F.when((category == "abandoned") & (F.locate("abandoned", whole) > 0), F.substring(whole, F.locate("abandoned", whole) + 9, F.length(whole))).otherwise(whole)
    cut = after
    for pivot in reversed(PIVOTS):  # the first in the list that occurs (not at the very beginning) wins
        at = F.instr(after, F.lit(pivot))
        cut = F.when(at > 1, F.substring(after, F.lit(1), at - 1)).otherwise(cut)
    about = F.when(category == "abandoned", cut).otherwise(whole)
    named = F.filter(entities, lambda e: F.contains(about, e) | F.contains(about, F.replace(e, F.lit("-"), F.lit(" "))) | F.contains(about, F.replace(e, F.lit("-"), F.lit(""))))
    return F.when(F.size(named) > 0, named).otherwise(entities)


def rejected(alternatives: Column) -> Column:
    parts = F.flatten(F.transform(alternatives, lambda a: F.split(F.regexp_replace(a, "[/,]", " "), r"\s+")))
    return F.array_distinct(F.filter(F.transform(parts, text.normal_entity), lambda x: F.length(x) > 2))


def contradictions(statements: DataFrame, records: DataFrame) -> DataFrame:
    """(statement_id, record_id, rule, entity, strength), by the first rule that holds and its first entity. Pairs come from an equi-join on an entity that a rule is about; no other pair is ever made.

    ``statements``: statement_id, statement, category, entities; ``records``: record_id, record_type, what, outcome, entities, rejected_alternatives."""
    s = statements.select("statement_id", "category", F.explode(F.array_distinct(subject(F.col("statement"), F.col("category"), F.col("entities")))).alias("entity"))
    headline = F.lower(F.concat_ws(" ", F.coalesce("what", F.lit("")), F.coalesce("outcome", F.lit(""))))
    r = records.select("record_id", "record_type", headline.alias("headline"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.coalesce(rejected(F.col("rejected_alternatives")), F.array().cast("array<string>")).alias("rejected"))
    said = lambda array: F.filter(array, lambda e: F.contains(F.col("headline"), e) | F.contains(F.col("headline"), F.replace(e, F.lit("-"), F.lit(" "))))
    # Three narrow joins: each side has only the entities that its rule can be about, so a pair that comes out is a contradiction.
    preference, gone = s.where(F.col("category").isin("tool_preference", "work_style")), s.where("category = 'abandoned'")
    rules = (
        (preference, r.select("record_id", F.explode("rejected").alias("entity")), 1),
        (preference, r.where("record_type = 'reversal'").select("record_id", F.explode(said(F.array_distinct("entities"))).alias("entity")), 2),
        (gone, r.where("record_type = 'decision'").select("record_id", F.explode(said(F.array_except("entities", "rejected"))).alias("entity")), 3),
    )
    hits = None
    for side, about, order in rules:
        met = side.join(about, "entity").select("statement_id", "record_id", F.struct(F.lit(order).alias("order"), "entity").alias("hit"))
        hits = met if hits is None else hits.unionByName(met)
    first = hits.groupBy("statement_id", "record_id").agg(F.min("hit").alias("hit"))
    named = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("hit.order"))
    return first.select("statement_id", "record_id", named(("rejected", "reversal", "readopted")).alias("rule"), F.col("hit.entity").alias("entity"), named((0.9, 0.85, 0.8)).alias("strength"))


def verdicts(found: DataFrame, records: DataFrame, now: Column, window_days: int = 90, threshold: int = 3) -> DataFrame:
    """Per statement: should it be superseded? One reversal within the window suffices, else ``threshold`` records."""
    recent = found.join(records.select("record_id", "record_type", "occurred_at"), "record_id").where((F.col("occurred_at") >= now - F.make_dt_interval(F.lit(window_days))) & (F.col("occurred_at") <= now))
    counts = recent.groupBy("statement_id").agg(F.count("*").alias("n_recent"), F.count_if(F.col("record_type") == "reversal").alias("n_reversals"))
    return counts.withColumn("supersede", (F.col("n_reversals") > 0) | (F.col("n_recent") >= threshold))


def support(statements: DataFrame, records: DataFrame, found: DataFrame) -> DataFrame:
    """(statement_id, record_id, occurred_at): the latest record since the last confirmation that shares an entity and contradicts nothing."""
    s = statements.select("statement_id", "last_confirmed_at", F.explode("entities").alias("entity"))
    r = records.select("record_id", "occurred_at", F.explode("entities").alias("entity"))
    agreeing = s.join(r, "entity").where(F.col("occurred_at") >= F.col("last_confirmed_at")).join(found.select("statement_id", "record_id"), ["statement_id", "record_id"], "left_anti")
    return agreeing.groupBy("statement_id").agg(F.max(F.struct("occurred_at", "record_id")).alias("last")).select("statement_id", "last.record_id", "last.occurred_at")


def ttl_scan(statements: DataFrame, supports: DataFrame, now: Column) -> DataFrame:
    """(statement_id, elapsed, effective_confidence, outcome): fresh, refreshed, needs review or dormant."""
    elapsed = scores.periods(F.col("last_confirmed_at"), now, F.col("ttl_days"))
    s = statements.join(supports.select("statement_id", F.col("record_id").alias("supported_by")), "statement_id", "left").withColumn("elapsed", elapsed.cast("bigint"))
    outcome = F.when(F.col("elapsed") < 1, "fresh").when(F.col("supported_by").isNotNull(), "refreshed").when(F.col("elapsed") >= 3, "dormant").otherwise("needs review")
    return s.select("statement_id", "elapsed", F.round(F.col("confidence") * scores.decay(F.col("elapsed")), 4).alias("effective_confidence"), outcome.alias("outcome"))


def proposals(found: DataFrame, statements: DataFrame, records: DataFrame) -> DataFrame:
    """(statement_id, winners, n, projects, impact): of the contradictions in ``found`` the three entities named most that the statement itself doesn't name, and what accepting it would weigh."""
    s = statements.select("statement_id", "confidence", F.col("entities").alias("losing"))
    each = found.select("statement_id", "record_id").join(records.select("record_id", "project_id", F.col("entities").alias("has")), "record_id").join(s, "statement_id")
    named = each.select("statement_id", F.explode(F.array_except("has", "losing")).alias("entity")).groupBy("statement_id", "entity").agg(F.count("*").alias("times"))
    first = F.row_number().over(Window.partitionBy("statement_id").orderBy(F.desc("times"), "entity"))
    top = named.withColumn("pos", first).where("pos <= 3").groupBy("statement_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity"))), lambda x: x["entity"]).alias("winners"))
    whole = each.groupBy("statement_id").agg(F.first("confidence").alias("confidence"), F.count("*").alias("n"), F.count_distinct("project_id").alias("projects"))
    impact = F.round(F.least(F.lit(1.0), F.col("confidence") * (0.5 + 0.15 * F.col("n")) + 0.1 * F.col("projects")), 4)
    return whole.join(top, "statement_id", "left").select("statement_id", F.coalesce("winners", F.array().cast("array<string>")).alias("winners"), "n", "projects", impact.alias("impact"))
