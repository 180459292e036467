"""Metrics over ``events``, sessions over ``conversations`` and the graph of the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import graph, sessions
from lodestone.sources.tables import stream, table
from lodestone.streaming import rollups


def _events(s, d):
    return table(s, d, "events")


def _errors():
    return F.sum((F.col("event_type") == "error").cast("long")).alias("errors")


def metrics_hourly(s, d):
    """24 zero-filled hours of one day."""
    day = _events(s, d).where("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'").groupBy(F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("calls"), _errors(), F.round(F.avg("value"), 2).alias("mean_value"))
    return s.range(24).select(F.col("id").cast("int").alias("hour")).join(day, "hour", "left").select(
        "hour", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("mean_value", F.lit(0.0)).alias("mean_value"))


def metrics_hourly_summary(s, d):
    return _events(s, d).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("calls"), _errors())


def metrics_daily(s, d):
    return _events(s, d).groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("calls"), _errors(), F.countDistinct("user_id").alias("users"),
        F.round(F.avg((F.col("event_type") != "error").cast("double")) * 100, 4).alias("success_rate"))


def metrics_by_model_key(s, d):
    """Two groupings of one input in one pass."""
    return _events(s, d).groupingSets([["event_type"], ["user_id"]], "event_type", "user_id").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"))


def metrics_running(s, d):
    run = W.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return _events(s, d).select("event_id", F.count(F.lit(1)).over(run).alias("calls"), F.min("value").over(run).alias("least"), F.max("value").over(run).alias("most"))


def metrics_level_rollup(s, d):
    return _events(s, d).rollup("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def metrics_stream_hourly(s, d):
    """Hours that the watermark, two hours behind the last event, has closed."""
    return rollups.drained(rollups.hourly(stream(s, d, "events")))


def style_state_stream(s, d):
    """Turns and characters of each session, kept as running state of a stream."""
    turns = stream(s, d, "conversations")
    return rollups.drained(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars")), "complete")


def rate_limit(s, d):
    """Users above the hourly limit in a tumbling window."""
    return _events(s, d).groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("user_id", F.date_format("h", "yyyy-MM-dd HH").alias("hour"), "n")


def _turns(s, d):
    return table(s, d, "conversations")


def session_last_n(s, d):
    return sessions.last_turns(_turns(s, d), 5).select("conv_id", "turn", "role", F.substring("text", 1, 200).alias("text"), "recency")


def session_context(s, d):
    last = sessions.last_turns(_turns(s, d), 3)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("t")))), lambda x: x["t"]), "\n")
    return last.groupBy("conv_id").agg(F.md5(lines).alias("digest"), F.count(F.lit(1)).alias("turns"))


def session_archive(s, d):
    return sessions.archive(_turns(s, d), 3)


def session_eligible(s, d):
    return _turns(s, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars")).where("turns >= 5 AND chars >= 200")


def memory_recall(s, d):
    """Additive rule score of turns: keyword 10, user 5, early turn 6; above 10."""
    score = F.when(F.lower("text").contains("token"), 10).otherwise(0) + F.when(F.col("role") == "user", 5).otherwise(0) + F.when(F.col("turn") < 2, 6).otherwise(0)
    return _turns(s, d).select("conv_id", "turn", score.alias("score")).where("score > 10")


def _graph(s, d):
    orders, lines = table(s, d, "orders"), table(s, d, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("bought").alias("type")).distinct()


def kg_stats(s, d):
    return _graph(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("relations"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def kg_degrees(s, d):
    return graph.degrees(_graph(s, d))


def kg_khop(s, d):
    seeds = s.createDataFrame([("c1",), ("c2",)], "id string")
    return graph.k_hop(_graph(s, d), seeds, 2)


def kg_relations_resolved(s, d):
    known = table(s, d, "part").where("p_size <= 10").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.concat(F.lit("entity_"), "p_partkey").alias("entity_id"))
    buyers = table(s, d, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.concat(F.lit("entity_c"), "c_custkey").alias("entity_id"))
    return graph.resolve(_graph(s, d), known.union(buyers))


def kg_entity_detail(s, d):
    return _graph(s, d).where("src = 'c1' OR dst = 'p1'")


def upsert_merge(s, d):
    """Orders updated by those of the last months: new rows win, old ones stay."""
    old, new = table(s, d, "orders").select("o_orderkey", "o_totalprice"), table(s, d, "orders").where("o_orderkey % 7 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("n"))
    return old.join(new, "o_orderkey", "full").select("o_orderkey", F.round(F.coalesce("n", "o_totalprice"), 2).alias("price"), F.col("n").isNotNull().alias("updated"))


def except_approved(s, d):
    return table(s, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey")


def revenue_by_flag(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


_G = "g AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, 'bought' AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_ERR = "CAST(sum(CAST(event_type = 'error' AS INTEGER)) AS BIGINT)"
_HOUR = "strftime(ts, '%Y-%m-%d %H')"

QUERIES = {f.__name__: f for f in (
    metrics_hourly, metrics_hourly_summary, metrics_daily, metrics_by_model_key, metrics_running, metrics_level_rollup, metrics_stream_hourly,
    style_state_stream, rate_limit, session_last_n, session_context, session_archive, session_eligible, memory_recall, kg_stats, kg_degrees, kg_khop,
    kg_relations_resolved, kg_entity_detail, upsert_merge, except_approved, revenue_by_flag)}
ORACLE = {
    "metrics_hourly": f"SELECT CAST(h AS INTEGER) AS hour, count(event_id) AS calls, coalesce({_ERR}, 0) AS errors, coalesce(round(avg(value), 2), 0) AS mean_value FROM range(24) r(h) LEFT JOIN events ON hour(ts) = h AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' GROUP BY h",
    "metrics_hourly_summary": f"SELECT {_HOUR} AS hour, count(*) AS calls, {_ERR} AS errors FROM events GROUP BY 1",
    "metrics_daily": f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, {_ERR} AS errors, count(DISTINCT user_id) AS users, round(avg(CAST(event_type <> 'error' AS DOUBLE)) * 100, 4) AS success_rate FROM events GROUP BY 1",
    "metrics_by_model_key": "SELECT event_type, user_id, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type), (user_id))",
    "metrics_running": "SELECT event_id, count(*) OVER w AS calls, min(value) OVER w AS least, max(value) OVER w AS most FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "metrics_level_rollup": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ROLLUP (event_type, strftime(ts, '%Y-%m-%d'))",
    "metrics_stream_hourly": f"SELECT {_HOUR} AS hour, count(*) AS calls, {_ERR} AS errors, round(avg(value), 6) AS mean_value FROM events GROUP BY 1 HAVING min(date_trunc('hour', ts)) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events)",
    "style_state_stream": "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1",
    "rate_limit": f"SELECT user_id, {_HOUR} AS hour, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
    "session_last_n": "SELECT conv_id, turn, role, substring(text, 1, 200) AS text, CAST(r AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5",
    "session_context": "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3 GROUP BY conv_id",
    "session_archive": "SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT role) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn <= m - 3 GROUP BY conv_id",
    "session_eligible": "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1 HAVING count(*) >= 5 AND sum(length(text)) >= 200",
    "memory_recall": "SELECT conv_id, turn, CAST(s AS INTEGER) AS score FROM (SELECT *, CASE WHEN contains(lower(text), 'token') THEN 10 ELSE 0 END + CASE WHEN role = 'user' THEN 5 ELSE 0 END + CASE WHEN turn < 2 THEN 6 ELSE 0 END AS s FROM conversations) WHERE s > 10",
    "kg_stats": f"WITH {_G} SELECT type, count(*) AS relations, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM g GROUP BY type",
    "kg_degrees": f"WITH {_G} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) GROUP BY id",
    "kg_khop": f"WITH {_G}, b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN ('c1', 'c2')), h2 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN (SELECT id FROM h1)), a AS (SELECT unnest(['c1', 'c2']) AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) SELECT id, min(hop) AS hop FROM a GROUP BY id",
    "kg_relations_resolved": f"WITH {_G}, e AS (SELECT 'p' || p_partkey AS name, 'entity_' || p_partkey AS i FROM part WHERE p_size <= 10 UNION ALL SELECT 'c' || c_custkey, 'entity_c' || c_custkey FROM customer WHERE c_acctbal > 5000) SELECT x.i AS src_id, y.i AS dst_id, type FROM g JOIN e x ON x.name = src JOIN e y ON y.name = dst",
    "kg_entity_detail": f"WITH {_G} SELECT * FROM g WHERE src = 'c1' OR dst = 'p1'",
    "upsert_merge": "SELECT o_orderkey, round(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS price, o_orderkey % 7 = 0 AS updated FROM orders",
    "except_approved": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "revenue_by_flag": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL",
}
