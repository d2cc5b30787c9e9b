"""Text rules, redaction, chunking, commits, gate, profile and reflection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import fixed_values as V
from cairn.functions import redact, scores, text, urls
from cairn.operators import chunking, commits, folds, gate, reflection
from cairn.plans.durable import durable
from cairn.plans.queries_store import C, R, records
from cairn.plans.registry import query
from cairn.session import spread, table

_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
_PIECES = r"list_filter(flatten(list_transform(regexp_extract_all({c}, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_\-+.#]*'), lambda w: regexp_split_to_array(w, '[\-_.+#]+'))), lambda p: p <> '')"
_TERMS = rf"list_distinct(list_transform(list_filter({_PIECES.format(c='prompt')}, lambda p: lower(p) NOT IN ({_STOP}) AND length(p) >= 2 AND (length(p) > 2 OR regexp_matches(p, '\d') OR (upper(p) = p AND lower(p) <> p))), lambda p: lower(p)))"
NOW = "2026-01-01"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"SELECT item_id, list_sort({_TERMS}) AS terms FROM eval_items")
def i3_question_terms(spark, d):
    return table(spark, d, "eval_items", "item_id", "prompt").select("item_id", F.array_sort(text.question_terms("prompt")).alias("terms"))


@query(rf"WITH {C} SELECT chunk_id, len(list_distinct(list_transform({_PIECES.format(c='text')}, lambda p: lower(p)))) AS n_words FROM c")
def i4_vocabulary(spark, d):
    return table(spark, d, "chunks", "chunk_id", "text").select("chunk_id", F.size(text.vocabulary("text")).cast("bigint").alias("n_words")).distinct()


@query(r"SELECT project_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(project_name), '[^\p{L}\p{N}]+'), lambda p: length(p) >= 2))) AS words, trim(regexp_replace(lower(project_name), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug FROM projects")
def i5_names(spark, d):
    return table(spark, d, "projects").select("project_id", F.array_sort(text.name_terms("project_name")).alias("words"), text.slug("project_name").alias("slug"))


@query(r"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(greatest(length(text) / 3.6::DOUBLE, len(regexp_extract_all(text, '\S+')) * 1.35::DOUBLE)))::BIGINT END AS tokens, substr(sha256(lower(trim(text, ' '))), 1, 16) AS prompt_hash FROM documents")
def i15_tokens(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.token_estimate("text").alias("tokens"), text.prompt_hash("text").alias("prompt_hash"))


@query(f"WITH {R} SELECT record_id, substr(sha256(project_id || chr(0) || record_type || chr(0) || coalesce(what, '') || chr(0) || coalesce(source_url, '')), 1, 32) AS natural_key FROM r")
def c1_content_hash(spark, d):
    return records(spark, d).select("record_id", text.content_hash("project_id", "record_type", "what", "source_url").alias("natural_key"))


_ALIAS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.ALIASES.items())
_BARE = "trim(lower(trim({x}, ' ')), '.,;:!?()[]{{}}\"''`')"
_NORMAL = "CASE " + _BARE + " " + _ALIAS + " ELSE " + _BARE + " END"


@query(f"""WITH {R}, known AS (SELECT DISTINCT {_NORMAL.format(x='e')} AS e FROM (SELECT unnest(entities) AS e FROM r) WHERE trim(e) <> ''),
t AS (SELECT item_id, regexp_extract_all(lower(prompt), '[a-z0-9][a-z0-9_.+#-]*') AS t FROM eval_items),
c AS (SELECT item_id, unnest(flatten(list_transform(t, lambda w: [w, replace(w, '_', '-'), replace(w, '-', '_'), rtrim(w, 's')])) || flatten(list_transform(range(1, len(t)), lambda i: [t[i] || ' ' || t[i + 1], t[i] || '-' || t[i + 1], t[i] || '_' || t[i + 1]]))) AS x FROM t),
n AS (SELECT item_id, {_NORMAL.format(x='x')} AS e FROM c)
SELECT item_id, list_sort(list(DISTINCT e)) AS named FROM n SEMI JOIN known USING (e) GROUP BY 1""")
def i13_named_entities(spark, d):
    """Entities of the records that a question names, whole, hyphenated, in the plural or in two words, by an equi-join of its candidate terms with the closed vocabulary."""
    known = records(spark, d, "entities").select(F.explode("entities").alias("entity")).where(F.trim("entity") != "").select(text.normal_entity(F.col("entity")).alias("entity")).distinct()
    asked = table(spark, d, "eval_items", "item_id", "prompt").select("item_id", F.explode(F.transform(text.candidate_terms("prompt"), text.normal_entity)).alias("entity")).distinct()
    return asked.join(known, "entity", "left_semi").groupBy("item_id").agg(F.array_sort(F.collect_set("entity")).alias("named"))


@query(f"WITH {R} SELECT record_id, round(pow(0.5, greatest(0, epoch(TIMESTAMP '{NOW}' - occurred_at) / 86400.0) / 240.0), 6) AS recency FROM r")
def i26_recency(spark, d):
    return records(spark, d, "occurred_at").select("record_id", F.round(scores.recency(F.col("occurred_at"), _now()), 6).alias("recency"))


def _sql_redact(c: str) -> str:
    for _, pattern, to in redact.RULES:
        pattern, to = pattern.replace("'", "''"), to.replace("$", "\\")
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


_LOGIN_SQL = f"CASE WHEN regexp_matches(text, '{redact.RULES[3][1].replace(chr(39), chr(39) * 2)}') THEN regexp_replace({_sql_redact('text')}, '{redact.LOGIN}', '\\1\\2[REDACTED:login]', 'g') ELSE {_sql_redact('text')} END"


@query(f"WITH {C} SELECT chunk_id, md5({_LOGIN_SQL}) AS redacted FROM c")
def h1_redacted(spark, d):
    """Deliveries are made distinct after the texts are reduced to digests."""
    return table(spark, d, "chunks", "chunk_id", "text").transform(spread).select("chunk_id", F.md5(redact.redact(F.col("text"))).alias("redacted")).distinct()


@query(f"WITH {C} SELECT kind, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter([{', '.join(f'CASE WHEN regexp_matches(text, ' + chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) + f') THEN ' + chr(39) + redact.KIND_OF.get(k, k) + chr(39) + ' END' for k, p, _ in redact.RULES)}], lambda x: x IS NOT NULL))) AS kind FROM c) GROUP BY 1")
def h9_audit(spark, d):
    """Stored passages that the rules would change today, by kind."""
    found = table(spark, d, "chunks", "chunk_id", "text").transform(spread).select("chunk_id", F.explode(redact.kinds(F.col("text"))).alias("kind"))
    return found.distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query(r"""WITH h AS (SELECT project_id, git_remote, lower(regexp_extract(git_remote, '^https?://([^/:]+)', 1)) AS host FROM projects WHERE git_remote IS NOT NULL),
deny AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain FROM h WHERE project_id % 5 = 0)
SELECT project_id, rtrim(git_remote, '/') AS url, host FROM h WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) NOT IN (SELECT domain FROM deny)""")
def b8_host_policy(spark, d):
    """Addresses that may be read, against a deny list that covers subdomains (here: the domains of every fifth project)."""
    p = table(spark, d, "projects", "project_id", "git_remote")
    denied = p.where("project_id % 5 = 0").select(F.regexp_extract(urls.host(F.col("git_remote")), r"([^.]+\.[^.]+)$", 1).alias("domain"))
    return urls.allowed(p, "git_remote", denied, "domain").select("project_id", urls.clean_url(F.col("git_remote")).alias("url"), urls.host(F.col("git_remote")).alias("host"))


@query()
def h6_secrets(spark, d):
    """Passages that hold a credential or an identifier, and what would be handed out in their place."""
    c = table(spark, d, "chunks", "chunk_id", "text").transform(spread).where(redact.contains_secret(F.col("text")))
    return c.select("chunk_id", F.md5(redact.withheld(F.col("text"))).alias("handed_out")).distinct()


@query()
def h10_redacted_records(spark, d):
    """Records as they may be stored: their texts redacted, withheld where something sensitive would remain."""
    clean = {c: redact.withheld(F.col(c)).alias(c) for c in ("what", "why", "outcome")}
    return records(spark, d, "what", "why", "outcome").select("record_id", *clean.values())


_METRIC = V.METRIC_LINE.replace("'", "''")


@query(f"""WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE source = 'run-logs'),
m AS (SELECT *, (pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 3 OR lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL)::INT AS opens FROM l WHERE regexp_matches(line, '{_METRIC}')),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS group_no FROM m)
SELECT doc_id, group_no::BIGINT AS group_no, greatest(1, min(pos))::BIGINT AS start_line, least(max(n), max(pos) + 2)::BIGINT AS end_line, count(*) AS n_metrics FROM g WHERE group_no <= 40 GROUP BY 1, 2""")
def j6_metric_groups(spark, d):
    logs = table(spark, d, "documents", "doc_id", "text", "source").where("source = 'run-logs'")
    return chunking.metric_groups(logs, "doc_id", "text")


@query()
def j2_passages(spark, d):
    """Every document cut into passages by its kind."""
    # The test table's notebooks are rendered as text; those in their own format are read cell by cell.
    kind = F.when((F.col("source_type") == "notebook") & ~F.ltrim("text").startswith("{"), "plain").otherwise(F.col("source_type"))
    return chunking.passages(table(spark, d, "documents", "doc_id", "text", "source_type").withColumn("kind", kind), "doc_id", "text", "kind")


@query(r"""WITH t AS (SELECT message_id, arg_max(session_id, received_at) AS session_id, arg_max(turn_timestamp, received_at) AS tm, arg_max(lower(trim(speaker)), received_at) AS speaker, arg_max(user_text, received_at) AS user_text, arg_max(reply_text, received_at) AS reply_text,
arg_max(is_meta OR is_sidechain, received_at) AS off FROM transcript_rows GROUP BY 1), s AS (SELECT *, count(*) FILTER (speaker IN ('user', 'human', 'you') AND trim(user_text) <> '') OVER (PARTITION BY session_id ORDER BY tm, message_id) AS turn FROM t WHERE NOT off)
SELECT session_id, turn, arg_max(message_id, (tm, message_id)) AS last_reply FROM s WHERE speaker IN ('assistant', 'ai', 'model') AND trim(reply_text) <> '' AND turn > 0 GROUP BY 1, 2""")
def f9_last_reply(spark, d):
    """Each turn's last reply, whatever the session's state: a running count by day and a carried sum over days."""
    from cairn.operators.sequences import running_count
    from cairn.operators.store import latest

    cols = ["message_id", "session_id", "turn_timestamp", "speaker", "user_text", "reply_text", "is_meta", "is_sidechain", "received_at"]
    t = latest(table(spark, d, "transcript_rows", *cols), ["message_id"], "received_at").where("not (is_meta or is_sidechain)")
    said = F.lower(F.trim("speaker"))
    user = F.coalesce(said.isin("user", "human", "you") & (F.trim("user_text") != ""), F.lit(False))
    s = running_count(t.withColumn("opens", user), ["session_id"], "turn_timestamp", "message_id", "opens", "turn")
    replies = s.where(said.isin("assistant", "ai", "model") & (F.trim("reply_text") != "") & (F.col("turn") > 0))
    return replies.groupBy("session_id", "turn").agg(F.max(F.struct("turn_timestamp", "message_id")).alias("last")).select("session_id", "turn", F.col("last.message_id").alias("last_reply"))


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", "source").where("source = 'git-history'").select("doc_id", "text")


_SUBJECT = r"trim(regexp_extract(text, '^\s*([^\r\n]*)', 1), ' ')"
_CONV = V.CONVENTIONAL


@query(rf"""WITH s AS (SELECT doc_id, {_SUBJECT} AS s FROM documents WHERE source = 'git-history')
SELECT doc_id, lower(regexp_extract(s, '{_CONV}', 1)) AS type, lower(regexp_extract(s, '{_CONV}', 2)) AS scope, CASE WHEN regexp_matches(s, '{_CONV}') THEN trim(regexp_extract(s, '{_CONV}', 4), ' ') ELSE s END AS summary,
nullif(trim(regexp_extract(s, '(?i)^revert\s+"?(.+?)"?$', 1), ' '), '') AS reverted FROM s""")
def i19_commit_form(spark, d):
    m = F.col("text")
    return _commits(spark, d).select("doc_id", commits.conventional(m).alias("c"), commits.reverted(m).alias("reverted")).select("doc_id", "c.type", "c.scope", "c.summary", "reverted")


@query()
def k14_records(spark, d):
    """Records read from commit messages: failures and reverts first, else decisions; at most one a commit, with reason, alternatives, entities and address."""
    m = F.col("text")
    c = table(spark, d, "documents", "doc_id", "text", "source", "project_key", "content_hash").where("source = 'git-history'")
    remotes = table(spark, d, "projects", "project_key", "git_remote")
    c = c.join(remotes, "project_key", "left").withColumn("why", commits.stated_reason(m)).withColumn("rejected", commits.rejected(m)).withColumn("entities", commits.named(m))
    found = c.withColumn("r", F.coalesce(commits.failure(m, F.col("why")), commits.decision(m, F.col("why"), F.col("entities"), F.col("rejected")))).where("r is not null")
    url = commits.source_url(F.col("git_remote"), F.col("project_key"), F.col("content_hash"))
    return found.select("doc_id", "r.record_type", "r.what", F.coalesce("why", F.lit("")).alias("why"), "r.outcome", "rejected", "entities", F.round("r.confidence", 2).alias("confidence"), F.col("why").isNull().alias("is_inference"), url.alias("source_url"))


_NOISE = "|".join(f"(?:{p})" for p in V.NOISE_SUBJECTS).replace("'", "''")


@query(rf"SELECT doc_id, length(lower({_SUBJECT})) < 8 OR regexp_matches(lower({_SUBJECT}), '{_NOISE}') AS is_noise FROM documents WHERE source = 'git-history'")
def i20_noise(spark, d):
    """Commits that are never worth a record."""
    return _commits(spark, d).select("doc_id", commits.is_noise(F.col("text")).alias("is_noise"))


_LEXICON = ", ".join(f"'{w}'" for w in V.TECH_LEXICON)


@query(rf"""WITH lex AS (SELECT unnest([{_LEXICON}]) AS w), c AS (SELECT doc_id, lower(text) AS t FROM documents WHERE source = 'git-history')
SELECT doc_id, list_sort(list(DISTINCT {_NORMAL.format(x='w')})) AS entities FROM c JOIN lex ON contains(t, lex.w) AND regexp_matches(t, '(?:^|[^a-z0-9])' || regexp_escape(w) || '\b') GROUP BY 1""")
def i20_commit_entities(spark, d):
    """Technical terms that a commit names, under their usual names."""
    return _commits(spark, d).select("doc_id", commits.named(F.col("text")).alias("entities")).where(F.size("entities") > 0)


_ANY = {k: "|".join(f"(?:{p})" for p in v).replace("'", "''") for k, v in (("mech", V.MECHANICAL), ("exp", V.EXPLAINING), ("weak", V.WEAKLY_MECHANICAL))}


@query(rf"""WITH x AS (SELECT item_id, lower(trim(prompt, ' ')) AS x, len(regexp_extract_all(prompt, '\S+')) AS n FROM eval_items)
SELECT item_id, CASE WHEN x = '' THEN 'empty prompt' WHEN regexp_matches(x, '{V.AUTOMATED}') THEN 'an automated message, not a prompt' WHEN regexp_matches(x, '{_ANY["mech"]}') THEN 'mechanical edit'
WHEN regexp_matches(x, '{_ANY["exp"]}') AND n <= 12 THEN 'asks about code already on screen' WHEN regexp_matches(x, '{_ANY["weak"]}') AND n <= 12 THEN 'short local edit naming nothing memory holds' END AS trivial FROM x""")
def k10_trivial(spark, d):
    return table(spark, d, "eval_items", "item_id", "prompt").select("item_id", gate.trivial_reason(F.col("prompt"), F.lit(False)).alias("trivial"))


@query()
def b10_gate(spark, d):
    """What each question may be answered from, and why."""
    named = i13_named_entities(spark, d)
    q = table(spark, d, "eval_items", "item_id", "prompt").join(named, "item_id", "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
    q = q.withColumn("task", gate.task_type("prompt"))
    decided = gate.decision(gate.trivial_reason(F.col("prompt"), F.size("named") > 0), F.col("task"), F.regexp_count("prompt", F.lit(r"\S+")), F.col("named"))
    return q.select("item_id", "task", decided.alias("g")).select("item_id", "task", "g.*")


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Standing statements for the profile operators: all records but reversals, by category."""
    category = F.when(F.col("record_type") == "decision", "tool_preference").when(F.col("record_type") == "experiment", "work_style").when(F.col("record_type") == "research", "constraint").otherwise("abandoned")
    days = F.when(category == "tool_preference", 90).when(category == "abandoned", 365).otherwise(180)
    r = records(spark, d).where("record_type <> 'reversal'")
    return r.select(F.col("record_id").alias("statement_id"), F.col("what").alias("statement"), category.alias("category"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), text.clean_set("entities").alias("entities"), F.col("occurred_at").alias("last_confirmed_at"), days.alias("ttl_days"), F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded").alias("status"))


_ST = f"""{R}, st AS (SELECT record_id AS statement_id, what AS statement, CASE record_type WHEN 'decision' THEN 'tool_preference' WHEN 'experiment' THEN 'work_style' WHEN 'research' THEN 'constraint' ELSE 'abandoned' END AS category, coalesce(confidence, 0.5) AS confidence,
list_sort(list_distinct(list_filter(list_transform(entities, lambda e: lower(trim(e))), lambda e: e <> ''))) AS entities, occurred_at AS last_confirmed_at, CASE record_type WHEN 'decision' THEN 90 WHEN 'failure' THEN 365 ELSE 180 END AS ttl_days FROM r WHERE record_type <> 'reversal')"""


@query(f"""WITH {_ST} SELECT statement_id, greatest(0, floor(epoch(TIMESTAMP '{NOW}' - last_confirmed_at) / 86400.0 / ttl_days))::BIGINT AS elapsed,
round(confidence * CASE greatest(0, floor(epoch(TIMESTAMP '{NOW}' - last_confirmed_at) / 86400.0 / ttl_days)) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0.0 END, 4) AS effective FROM st""")
def i27_decay(spark, d):
    elapsed = scores.periods(F.col("last_confirmed_at"), _now(), F.col("ttl_days")).cast("bigint")
    return statements(spark, d).select("statement_id", elapsed.alias("elapsed"), F.round(F.col("confidence") * scores.decay(elapsed), 4).alias("effective"))


@query(f"WITH {_ST} SELECT category, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, min(last_confirmed_at) AS oldest FROM st GROUP BY 1")
def e8_profile_stats(spark, d):
    return statements(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("last_confirmed_at").alias("oldest"))


def _reflection_records(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).withColumn("entities", text.clean_set("entities"))


_NAMED = "list_filter({a}, lambda e: contains({t}, e) OR contains({t}, replace(e, '-', ' ')) OR contains({t}, replace(e, '-', '')))"
_CUT = "substr(lower(statement), position('abandoned' IN lower(statement)) + 9)"


def _sql_pivots() -> str:
    t = f"CASE WHEN position('abandoned' IN lower(statement)) > 0 THEN {_CUT} ELSE lower(statement) END"
    arms = " ".join(f"WHEN position('{p}' IN ({t})) > 1 THEN substr(({t}), 1, position('{p}' IN ({t})) - 1)" for p in reflection.PIVOTS)
    return f"CASE WHEN category <> 'abandoned' THEN lower(statement) ELSE CASE {arms} ELSE ({t}) END END"


_CONTRA = f"""{_ST}, s AS (SELECT statement_id, category, CASE WHEN len({_NAMED.format(a='entities', t='about')}) > 0 THEN {_NAMED.format(a='entities', t='about')} ELSE entities END AS subject FROM (SELECT *, {_sql_pivots()} AS about FROM st)),
x AS (SELECT record_id, record_type, occurred_at, lower(concat_ws(' ', coalesce(what, ''), coalesce(outcome, ''))) AS headline, list_sort(list_distinct(list_filter(list_transform(entities, lambda e: lower(trim(e))), lambda e: e <> ''))) AS ents,
list_distinct(list_filter(list_transform(flatten(list_transform(rejected_alternatives, lambda a: regexp_split_to_array(regexp_replace(a, '[/,]', ' ', 'g'), '\\s+'))), lambda w: CASE trim(lower(trim(w, ' ')), '.,;:!?()[]{{}}"''`') {_ALIAS} ELSE trim(lower(trim(w, ' ')), '.,;:!?()[]{{}}"''`') END), lambda w: length(w) > 2)) AS rej FROM r),
j AS (SELECT s.*, x.*, list_sort(list_intersect(subject, rej)) AS down, list_sort(list_filter(list_intersect(subject, ents), lambda e: contains(headline, e) OR contains(headline, replace(e, '-', ' ')))) AS rev FROM s, x WHERE len(list_intersect(subject, ents || rej)) > 0),
hits AS (SELECT statement_id, record_id, record_type, occurred_at, CASE WHEN category IN ('tool_preference', 'work_style') AND len(down) > 0 THEN 'rejected' WHEN category IN ('tool_preference', 'work_style') AND record_type = 'reversal' AND len(rev) > 0 THEN 'reversal'
WHEN category = 'abandoned' AND record_type = 'decision' AND len(list_filter(rev, lambda e: NOT list_contains(rej, e))) > 0 THEN 'readopted' END AS rule, CASE WHEN category = 'abandoned' THEN list_filter(rev, lambda e: NOT list_contains(rej, e))[1] WHEN len(down) > 0 THEN down[1] ELSE rev[1] END AS entity FROM j)"""


@query(f"WITH {_CONTRA} SELECT statement_id, record_id, rule, entity FROM hits WHERE rule IS NOT NULL")
def d9_contradictions(spark, d):
    return reflection.contradictions(statements(spark, d), _reflection_records(spark, d)).select("statement_id", "record_id", "rule", "entity")


@query(f"""WITH {_CONTRA} SELECT statement_id, count(*) AS n_recent, count(*) FILTER (record_type = 'reversal') AS n_reversals, count(*) FILTER (record_type = 'reversal') > 0 OR count(*) >= 3 AS supersede
FROM hits WHERE rule IS NOT NULL AND occurred_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND occurred_at <= TIMESTAMP '{NOW}' GROUP BY 1""")
def k17_verdicts(spark, d):
    r = _reflection_records(spark, d)
    return reflection.verdicts(reflection.contradictions(statements(spark, d), r), r, _now())


@query()
def e14_proposals(spark, d):
    """Replacements for the statements that recent records overrule: winners (E14) and impact (I36)."""
    # Written tables: each is read by several steps.
    s, r = durable(statements(spark, d), "statements"), durable(_reflection_records(spark, d), "records")
    found = durable(reflection.contradictions(s, r), "contradictions")
    overruled = reflection.verdicts(found, r, _now()).where("supersede").select("statement_id")
    recent = r.where((F.col("occurred_at") >= _now() - F.make_dt_interval(F.lit(90))) & (F.col("occurred_at") <= _now())).select("record_id")
    evidence = found.join(overruled, "statement_id", "left_semi").join(recent, "record_id", "left_semi")
    return reflection.proposals(evidence, s, r)


_SUPPORT = f"""{_CONTRA}, bad AS (SELECT DISTINCT statement_id, record_id FROM hits WHERE rule IS NOT NULL), sup AS (SELECT st.statement_id, x.record_id, x.occurred_at FROM st JOIN x ON len(list_intersect(st.entities, x.ents)) > 0 AND x.occurred_at >= st.last_confirmed_at ANTI JOIN bad ON bad.statement_id = st.statement_id AND bad.record_id = x.record_id),
last AS (SELECT statement_id, arg_max(record_id, (occurred_at, record_id)) AS record_id, max(occurred_at) AS occurred_at FROM sup GROUP BY 1)"""


@query(f"WITH {_SUPPORT} SELECT * FROM last")
def d10_support(spark, d):
    s, r = statements(spark, d), _reflection_records(spark, d)
    return reflection.support(s, r, reflection.contradictions(s, r))


@query(f"""WITH {_SUPPORT}, t AS (SELECT st.*, greatest(0, floor(epoch(TIMESTAMP '{NOW}' - last_confirmed_at) / 86400.0 / ttl_days))::BIGINT AS elapsed, last.record_id AS supported FROM st LEFT JOIN last USING (statement_id))
SELECT statement_id, elapsed, round(confidence * CASE elapsed WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0.0 END, 4) AS effective_confidence, CASE WHEN elapsed < 1 THEN 'fresh' WHEN supported IS NOT NULL THEN 'refreshed' WHEN elapsed >= 3 THEN 'dormant' ELSE 'needs review' END AS outcome FROM t""")
def k18_ttl_scan(spark, d):
    s, r = statements(spark, d), _reflection_records(spark, d)
    return reflection.ttl_scan(s, reflection.support(s, r, reflection.contradictions(s, r)), _now())


@query()
def k11_profile_slice(spark, d):
    """Per category (standing for a caller) the statements that fit a budget of tokens: best first, one too big is skipped, at most fifteen."""
    s = statements(spark, d).where("status = 'active'")
    elapsed = scores.periods(F.col("last_confirmed_at"), _now(), F.col("ttl_days"))
    relevance = F.when(F.size("entities") == 0, 0.9).when(F.col("category").isin("work_style", "constraint"), 0.9).otherwise(0.3)
    scored = s.withColumn("score", F.round(F.col("confidence") * scores.decay(elapsed) * relevance, 6)).where("score > 0").withColumn("tokens", text.token_estimate(F.concat(F.lit("- "), F.col("statement"))))
    # The fold keeps at most fifteen and skips what is too big, so of each size only the best fifteen can matter: an exact cut, for of two statements of one size the better is always taken first.
    from cairn.operators.store import top_k

    ranked = top_k(scored.select("category", "statement_id", "statement", "score", "tokens").where(F.col("tokens") <= V.PROFILE_TOKENS), ["category", "tokens"], [F.desc("score"), F.col("statement"), F.col("statement_id")], V.MAX_STATEMENTS).drop("rank")
    return folds.fit_budget(ranked, ["category"], [-F.col("score"), F.col("statement")], "tokens", V.PROFILE_TOKENS, V.MAX_STATEMENTS).select("category", "statement_id", "score", "tokens", "used")


@query(r"SELECT suffix, source_type, count(*) AS n FROM (SELECT DISTINCT document_id, source_type, lower(regexp_extract(uri, '\.([A-Za-z0-9]+)$', 1)) AS suffix FROM source_documents) GROUP BY 1, 2")
def a2_suffixes(spark, d):
    s = F.lower(F.regexp_extract("uri", r"\.([A-Za-z0-9]+)$", 1))
    return table(spark, d, "source_documents", "document_id", "source_type", "uri").select("document_id", "source_type", s.alias("suffix")).distinct().groupBy("suffix", "source_type").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT project_key, root_path FROM projects WHERE root_path IS NOT NULL), f AS (SELECT DISTINCT document_id, uri FROM source_documents)
SELECT document_id, coalesce((SELECT arg_max(project_key, length(root_path)) FROM p WHERE starts_with(uri, root_path || '/')), split_part(uri, '/', 4)) AS project_key FROM f WHERE starts_with(uri, '/srv/')""")
def a4_attribution(spark, d):
    """The project whose root is the longest prefix of a path, else the folder below the source's root: an equi-join on the path's own prefixes."""
    f = table(spark, d, "source_documents", "document_id", "uri").where(F.startswith("uri", F.lit("/srv/"))).distinct()
    parts = F.split("uri", "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    roots = table(spark, d, "projects").where("root_path is not null").select(F.col("root_path").alias("prefix"), F.col("project_key").alias("found"))
    best = f.select("document_id", F.explode(prefixes).alias("prefix")).join(roots, "prefix").groupBy("document_id").agg(F.max_by("found", F.length("prefix")).alias("found"))
    return f.join(best, "document_id", "left").select("document_id", F.coalesce("found", F.split_part("uri", F.lit("/"), F.lit(4))).alias("project_key"))
