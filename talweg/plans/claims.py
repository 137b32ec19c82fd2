"""Queries of conflicting claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.catalog import Tables
from talweg.operators import claims, relational
from talweg.plans.registry import query

_ID = "l_orderkey * 10 + l_linenumber"
_LINKS = f"""
c AS (SELECT {_ID} AS id, l_suppkey AS side, l_extendedprice AS v, l_returnflag = 'R' AS derived, l_returnflag = 'A' AS origin FROM lineitem),
e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.side = b.side AND a.derived AND b.origin AND abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1e-9) <= 0.0002),
u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS node, x AS seen FROM u UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.seen),
k AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)
"""


def _claims(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("side"), F.col("l_extendedprice").alias("v"), F.col("l_returnflag").alias("kind"))


def _lineages(t: Tables) -> DataFrame:
    return claims.lineages(_claims(t), ["side"], "id", "v", F.col("kind") == "R", F.col("kind") == "A", 0.0002)


@query(f"WITH RECURSIVE {_LINKS} SELECT c.id, coalesce(component, c.id) AS lineage FROM c LEFT JOIN k ON node = c.id")
def claim_lineages(t: Tables) -> DataFrame:
    return _lineages(t).select("id", "lineage")


@query(f"WITH RECURSIVE {_LINKS}, l AS (SELECT c.*, coalesce(component, c.id) AS lineage FROM c LEFT JOIN k ON node = c.id) SELECT id, lineage FROM (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY derived, id) AS n FROM l) WHERE n = 1")
def collapse_lineages(t: Tables) -> DataFrame:
    return claims.collapse_lineages(_lineages(t), "id", F.col("kind") == "R").select("id", "lineage")


_RANGES = "SELECT event_id AS id, user_id AS side, event_type AS kind, value AS v, event_id % 3 = 0 AS lower, event_id % 5 = 0 AS upper FROM events"


@query(f"""
WITH c AS ({_RANGES}), g AS (SELECT *, CASE WHEN lower <> upper AND lower THEN v END AS lo, CASE WHEN lower <> upper AND upper THEN v END AS hi FROM c),
w AS (SELECT *, count(lo) OVER p AS nl, count(hi) OVER p AS nh, max(lo) OVER p AS a, max(hi) OVER p AS b FROM g WINDOW p AS (PARTITION BY side, kind)),
m AS (SELECT *, coalesce(nl = 1 AND nh = 1 AND a > 0 AND a <= b, false) AND (lo IS NOT NULL OR hi IS NOT NULL) AS merged FROM w)
SELECT id, round(CASE WHEN merged THEN sqrt(a * b) ELSE v END, 9) AS v, round(CASE WHEN merged THEN power(ln(b / a) / 4, 2) ELSE 0 END, 9) AS range_var, merged FROM m WHERE NOT (merged AND hi IS NOT NULL)
""")
def merge_range_pairs(t: Tables) -> DataFrame:
    c = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("side"), F.col("event_type").alias("kind"), F.col("value").alias("v"))
    out = claims.merge_ranges(c, ["side", "kind"], "id", "v", F.col("id") % 3 == 0, F.col("id") % 5 == 0)
    return out.select("id", F.round("v", 9).alias("v"), F.round("range_var", 9).alias("range_var"), "merged")


@query("""
WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS side, l_extendedprice AS v, l_returnflag = 'N' AS bare FROM lineitem)
SELECT id FROM c WHERE id NOT IN (SELECT a.id FROM c a JOIN c b ON b.side = a.side AND a.bare AND NOT b.bare AND abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1e-9) <= 0.0005)
""")
def cross_regime_dedupe(t: Tables) -> DataFrame:
    return claims.drop_unlabelled_copies(_claims(t), ["side"], "id", "v", F.col("kind") == "N", 0.0005).select("id")


@query("""
SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_linestatus = 'O' AND l_discount = 0 THEN 'full_price' WHEN l_quantity < 5 THEN 'small' END AS reason, count(*) AS n FROM lineitem
WHERE l_returnflag = 'R' OR (l_linestatus = 'O' AND l_discount = 0) OR l_quantity < 5 GROUP BY 1
""")
def exclusion_reasons(t: Tables) -> DataFrame:
    rules = [(F.col("l_returnflag") == "R", "returned"), ((F.col("l_linestatus") == "O") & (F.col("l_discount") == 0), "full_price"), (F.col("l_quantity") < 5, "small")]
    return relational.excluded(t.lineitem, rules)[1]


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_quantity ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n = 1")
def same_source_dedupe(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return claims.first_of_source(rows, ["l_suppkey", "l_returnflag", "l_quantity"], "at").select("l_orderkey", "l_linenumber")


@query("""
SELECT DISTINCT user_id FROM (SELECT user_id FROM events WHERE value > 90 UNION SELECT a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id % 7 = 0 AND b.event_id % 11 = 0)
""")
def sides_with_range(t: Tables) -> DataFrame:
    return claims.sides_with_range(t.events, "user_id", "event_type", F.col("event_id") % 7 == 0, F.col("event_id") % 11 == 0, F.col("value") > 90)


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS arm, l_quantity AS v, l_linestatus = 'O' AS contingent FROM lineitem WHERE l_discount < 0.09),
a AS (SELECT l_orderkey, sum(v) AS sa, count(*) AS na FROM r WHERE contingent GROUP BY 1), b AS (SELECT l_orderkey, sum(v) AS sb, count(*) AS nb FROM (SELECT l_orderkey, arm, max(v) AS v FROM r WHERE NOT contingent GROUP BY 1, 2) GROUP BY 1)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, round(greatest(CASE WHEN na >= 2 THEN sa END, CASE WHEN nb >= 2 THEN sb END), 6) AS total FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey WHERE na >= 2 OR nb >= 2
""")
def derived_totals(t: Tables) -> DataFrame:
    out = claims.larger_sum(t.lineitem, ["l_orderkey"], "l_quantity", "l_returnflag", F.col("l_linestatus") == "O", F.col("l_discount") >= 0.09)
    return out.withColumn("total", F.round("total", 6))
