"""Relational and event-time queries over the driver's star schema and event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import store
from cairn.plans.registry import query
from cairn.session import table


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def t_pricing_summary(spark, d):
    x = table(spark, d, "lineitem").where(F.col("l_shipdate") <= _ts("1998-09-02"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("""SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2""")
def t_revenue_by_nation(spark, d):
    """Region and nation are of fixed size; the other sides are left to the optimizer."""
    where = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, d, "customer", "c_custkey", "c_nationkey").join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    sold = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(table(spark, d, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = sold.join(table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).where("s_nationkey <> c_nationkey")
    return joined.groupBy("n_name", "r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("n_orders"))


@query("SELECT p_brand, l_returnflag, sum(l_quantity) AS qty, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY CUBE (p_brand, l_returnflag)")
def t_cube(spark, d):
    x = table(spark, d, "lineitem", "l_partkey", "l_returnflag", "l_quantity").join(table(spark, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return x.cube("p_brand", "l_returnflag").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def t_semi_anti(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), on, "left_anti").join(o, on, "left_semi")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def t_top_orders(spark, d):
    return store.top_k(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("rank")


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def t_pivot(spark, d):
    wide = table(spark, d, "orders", "o_orderstatus", "o_orderpriority").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderstatus", *(F.coalesce(F.col(c), F.lit(0)).alias(n) for c, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low"))))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def g_tumbling(spark, d):
    from cairn.streaming.windows import tumbling

    return tumbling(table(spark, d, "events"), "1 hour").select("start_at", "event_type", "n", "total")


@query("""SELECT start_at, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS start_at, event_type FROM events) GROUP BY 1, 2""")
def g_sliding(spark, d):
    from cairn.streaming.windows import sliding

    return sliding(table(spark, d, "events"), "1 hour", "15 minutes").select("start_at", "event_type", "n")


_SESSIONS = """SELECT user_id, min(ts) AS start_at, max(ts) AS last_at, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE)::INT AS brk FROM events)) GROUP BY user_id, s"""


@query(_SESSIONS)
def g_sessions(spark, d):
    from cairn.streaming.windows import sessions

    return sessions(table(spark, d, "events"), "30 minutes").select("user_id", "start_at", "last_at", "n")


@query(f"SELECT * FROM ({_SESSIONS}) WHERE last_at + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def g_sessions_streamed(spark, d):
    """The same sessions by a stream with a watermark of two days: the closed ones."""
    from cairn.streaming.windows import stream_to_table, stream_sessions

    closed = stream_to_table(stream_sessions(spark, f"{d}/events.parquet", "30 minutes", "2 days"), "sessions")
    bound = table(spark, d, "events", "ts").agg((F.max("ts") - F.expr("interval 2 days")).alias("bound"))
    return closed.join(bound).where(F.col("last_at") + F.expr("interval 30 minutes") <= F.col("bound")).select("user_id", "start_at", "last_at", "n")


@query("SELECT event_id, min(ts) AS ts FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE value > 10) GROUP BY 1")
def g_deduplicated_stream(spark, d):
    """Deliveries within two days of each other count once."""
    from cairn.streaming.windows import stream_deduplicated, stream_to_table

    return stream_to_table(stream_deduplicated(spark, f"{d}/events.parquet", "2 days"), "deduplicated").select("event_id", "ts")


@query("SELECT session_id, count(DISTINCT message_id) AS n_turns FROM transcript_rows WHERE lower(trim(speaker)) IN ('user', 'human', 'you') AND NOT is_meta AND NOT is_sidechain AND turn_timestamp IS NOT NULL GROUP BY 1")
def g_turn_counts_streamed(spark, d):
    """A stateful stream: distinct user messages by session, carried from batch to batch."""
    from cairn.streaming.transcripts import stream_turn_counts
    from cairn.streaming.windows import stream_to_table

    counts = stream_to_table(stream_turn_counts(spark, f"{d}/transcript_rows.parquet"), "turn_counts", mode="update")
    return counts.groupBy("session_id").agg(F.max("n_turns").alias("n_turns"))


@query("SELECT user_id, event_type, try_cast(props->>'k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2, 3")
def i_json_fields(spark, d):
    e = table(spark, d, "events", "user_id", "event_type", "props")
    return e.groupBy("user_id", "event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, ts, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running FROM events")
def f_running_total(spark, d):
    from cairn.operators.sequences import running_sum

    summed = running_sum(table(spark, d, "events", "event_id", "user_id", "ts", "value"), ["user_id"], "ts", "event_id", F.col("value"), "running")
    return summed.select("event_id", "user_id", "ts", F.round("running", 4).alias("running"))


@query("SELECT vec_id, label, arg_max(other, (sim, -other)) AS nearest, round(max(sim), 4) AS similarity FROM (SELECT a.vec_id, a.label, b.vec_id AS other, round(list_dot_product(a.embedding, b.embedding)::DOUBLE, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label) GROUP BY 1, 2")
def k9_vector_search(spark, d):
    """Exact search within a label: queries are laid over blocks of the collection, one matrix product each."""
    from cairn.operators.vectors import nearest_exact

    v = table(spark, d, "embeddings")
    return nearest_exact(v, v, "vec_id", "embedding", 1, group="label").select("vec_id", "label", F.col("neighbour").alias("nearest"), F.round("similarity", 4).alias("similarity"))
