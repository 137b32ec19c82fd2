"""Queries of keyed writes, caches, chunks and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.catalog import Tables
from talweg.operators import gates, relational
from talweg.plans.registry import query

_OLD, _NEW = "SELECT o_orderkey, o_orderstatus AS role, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS evidence, o_totalprice AS at FROM orders WHERE o_orderkey % 5 < 3", "SELECT o_orderkey, 'X' AS role, CASE WHEN o_orderkey % 2 > 0 THEN 'new' END AS evidence, o_totalprice + 1 AS at FROM orders WHERE o_orderkey % 5 > 1"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    o, k = t.orders, F.col("o_orderkey")
    old = o.filter(k % 5 < 3).select(k, F.col("o_orderstatus").alias("role"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("evidence"), F.col("o_totalprice").alias("at"))
    new = o.filter(k % 5 > 1).select(k, F.lit("X").alias("role"), F.when(k % 2 > 0, "new").alias("evidence"), (F.col("o_totalprice") + 1).alias("at"))
    return old, new


@query(f"""
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.role, b.role) AS role, CASE WHEN a.o_orderkey IS NULL THEN b.evidence WHEN b.o_orderkey IS NULL THEN a.evidence ELSE coalesce(b.evidence, a.evidence) END AS evidence, coalesce(b.at, a.at) AS at
FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.o_orderkey = b.o_orderkey
""")
def upsert_merge(t: Tables) -> DataFrame:
    old, new = _sides(t)
    return relational.upsert(old, new, ["o_orderkey"], {"role": "old", "evidence": "prefer"})


@query(f"SELECT * FROM ({_OLD}) UNION ALL SELECT * FROM ({_NEW}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_OLD}))")
def insert_missing(t: Tables) -> DataFrame:
    return relational.insert_missing(*_sides(t), ["o_orderkey"])


@query(f"SELECT * FROM ({_OLD}) WHERE role <> 'F' UNION ALL SELECT * FROM ({_NEW})")
def replace_owned(t: Tables) -> DataFrame:
    return relational.replace_owned(*_sides(t), F.col("role") == "F")


@query(f"SELECT * FROM ({_OLD}) WHERE o_orderkey IN (SELECT o_orderkey FROM ({_NEW})) OR role = 'P'")
def stale_delete(t: Tables) -> DataFrame:
    return relational.remove_stale(*_sides(t), ["o_orderkey"], F.col("role") == "P")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' OR o_orderpriority = '5-LOW' THEN 'rule' ELSE o_orderstatus END AS kind FROM orders")
def conditional_update(t: Tables) -> DataFrame:
    owned = (F.col("o_orderstatus") == "O") | (F.col("o_orderpriority") == "5-LOW")
    return t.orders.select("o_orderkey", F.when(owned, "rule").otherwise(F.col("o_orderstatus")).alias("kind"))


@query("""
WITH l AS (SELECT user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) AS answer FROM events WHERE value > 20 GROUP BY 1) SELECT DISTINCT e.user_id, answer FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN l ON l.user_id = e.user_id
""")
def cached_answers(t: Tables) -> DataFrame:
    log = t.events.select("user_id", F.col("event_id").alias("answer"), "value", F.struct("ts", "event_id").alias("at"))
    return relational.cached_answers(t.events.select("user_id").distinct(), log, "user_id", F.col("value") > 20, "at", "answer")


@query("""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1) SELECT event_id, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id, user_id) - 1) / 25) AS BIGINT) AS chunk FROM f
""")
def request_chunks(t: Tables) -> DataFrame:
    return relational.chunked(t.events, "user_id", ["event_type"], "event_id", 25).select("event_id", "chunk")


_GATES = """
SELECT 'weights_sum' AS name, CAST((SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING abs(sum(l_discount + l_tax) - 1) > 0.95)) AS DOUBLE) AS actual UNION ALL
SELECT 'orphans', CAST((SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS DOUBLE) UNION ALL
SELECT 'coverage', (SELECT round(count(DISTINCT o_custkey) / (SELECT count(*) FROM customer), 9) FROM orders) UNION ALL
SELECT 'median_width', (SELECT round(quantile_cont(ln(l_extendedprice / l_quantity), 0.5), 9) FROM lineitem WHERE l_quantity > 0) UNION ALL
SELECT 'empty', NULL
"""
_LIMITS = "SELECT * FROM (VALUES ('weights_sum', '<', 50.0, 'warning'), ('orphans', '=', 0.0, 'error'), ('coverage', '>=', 0.5, 'error'), ('median_width', '<', 9.0, 'warning'), ('empty', '>=', 0.0, 'warning')) v(name, op, threshold, severity)"


@query(f"""
WITH a AS ({_GATES}), l AS ({_LIMITS}) SELECT name, actual, op || ' ' || CAST(threshold AS VARCHAR) AS threshold, severity, coalesce(CASE op WHEN '<' THEN actual < threshold WHEN '=' THEN abs(actual - threshold) <= 1e-9 ELSE actual >= threshold END, false) AS passed FROM a JOIN l USING (name)
""")
def gate_results(t: Tables) -> DataFrame:
    t_ = {n: getattr(t, n) for n in ("lineitem", "orders", "customer")}
    specs = [
        gates.Gate("weights_sum", "< 50.0", "warning", lambda x: gates.rows(x["lineitem"].groupBy("l_orderkey").agg(F.sum(F.col("l_discount") + F.col("l_tax")).alias("s")).filter(F.abs(F.col("s") - 1) > 0.95))),
        gates.Gate("orphans", "= 0.0", "error", lambda x: gates.rows(x["orders"].join(x["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti"))),
        gates.Gate("coverage", ">= 0.5", "error", lambda x: x["customer"].join(x["orders"].select("o_custkey").distinct(), F.col("o_custkey") == F.col("c_custkey"), "left").agg(F.round(F.try_divide(F.count("o_custkey"), F.count("*")), 9).alias("actual"))),
        gates.Gate("median_width", "< 9.0", "warning", lambda x: gates.whole_quantile(x["lineitem"].filter("l_quantity > 0"), F.log(F.col("l_extendedprice") / F.col("l_quantity")), 0.5).select(F.round("actual", 9).alias("actual"))),
        gates.Gate("empty", ">= 0.0", "warning", lambda x: x["orders"].limit(0).agg(F.avg("o_totalprice").alias("actual"))),
    ]
    return gates.run(specs, t_).select("name", "actual", "threshold", "severity", "passed")
