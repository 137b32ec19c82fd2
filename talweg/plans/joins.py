"""Queries of joins, set operations and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talweg.catalog import Tables
from talweg.operators import graph, relational
from talweg.plans.registry import query


@query("""
SELECT o_orderkey, l_linenumber, s_name, n_name, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE o_orderstatus = 'F'
""")
def overview_join(t: Tables) -> DataFrame:
    j = t.orders.filter("o_orderstatus = 'F'").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return j.select("o_orderkey", "l_linenumber", "s_name", "n_name", "l_quantity")


@query("""
SELECT c_custkey, c_name, n_name, o_orderkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000
""")
def left_join_context(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 300000")
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(big, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("c_custkey", "c_name", "n_name", "o_orderkey")


@query("""
SELECT s_suppkey, s_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_lines,
       (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS n_returned FROM supplier
""")
def counts_from_subqueries(t: Tables) -> DataFrame:
    li = t.lineitem
    return relational.left_with_counts(t.supplier.select("s_suppkey", "s_name"), "s_suppkey", (li, "l_suppkey", "n_lines"), (li.filter("l_returnflag = 'R'"), "l_suppkey", "n_returned"))


@query("""
SELECT n, count(*) AS keys FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY n
""")
def histogram_of_counts(t: Tables) -> DataFrame:
    return relational.histogram_of_counts(t.customer, "c_custkey", t.orders, "o_custkey")


@query("""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
""")
def semi_and_anti_join(t: Tables) -> DataFrame:
    key = F.col("o_custkey") == F.col("c_custkey")
    some = t.customer.select("c_custkey").join(t.orders.filter("o_orderstatus = 'O'"), key, "left_semi")
    return some.join(t.orders.filter("o_orderpriority = '1-URGENT'"), key, "left_anti")


@query("""
SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)
AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)
""")
def triple_anti_join(t: Tables) -> DataFrame:
    li = t.lineitem
    return relational.unreferenced(t.part, "p_partkey", (li.filter("l_quantity > 40"), "l_partkey"), (li.filter("l_returnflag = 'R'"), "l_partkey"), (li.filter("l_discount > 0.08"), "l_partkey")).select("p_partkey", "p_name")


@query("""
SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber IS DISTINCT FROM a.l_linenumber AND b.l_discount = 0) AS other_full_price
FROM lineitem a
""")
def other_side_exists(t: Tables) -> DataFrame:
    full = F.col("l_discount") == 0
    n = F.count_if(full).over(Window.partitionBy("l_orderkey"))
    own = F.count_if(full).over(Window.partitionBy("l_orderkey", "l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", (n > own).alias("other_full_price"))


@query("""
SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 7
""")
def banded_pairs(t: Tables) -> DataFrame:
    days = t.orders.withColumn("day", F.unix_date(F.to_date("o_orderdate")))
    return relational.banded_pairs(days, "o_orderkey", ["o_custkey"], "day", 7)


@query("""
WITH r AS (SELECT s_suppkey, s_nationkey, min(CAST(l_shipdate AS DATE)) AS lo, min(CAST(l_shipdate AS DATE)) + 60 AS hi FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT a.s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b FROM r a JOIN r b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND (a.lo IS NULL OR b.lo IS NULL OR (a.lo < b.hi AND b.lo < a.hi))
""")
def interval_overlap_pairs(t: Tables) -> DataFrame:
    first = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.to_date(F.min("l_shipdate")).alias("low"))
    spans = t.supplier.select("s_suppkey", "s_nationkey").join(first, "s_suppkey", "left").withColumn("high", F.date_add("low", 60))
    return relational.overlapping_pairs(spans, "s_suppkey", ["s_nationkey"], "low", "high")


@query("""
WITH k AS (SELECT s_suppkey, s_nationkey AS k1, CAST(floor(s_acctbal / 50) AS BIGINT) AS k2 FROM supplier)
SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM k a JOIN k b ON a.s_suppkey < b.s_suppkey AND (a.k1 = b.k1 OR a.k2 = b.k2)
""")
def either_key_pairs(t: Tables) -> DataFrame:
    keyed = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("k1"), F.floor(F.col("s_acctbal") / 50).alias("k2"))
    return relational.either_key_pairs(keyed, "s_suppkey", ["k1", "k2"])


@query("""
SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS low, greatest(a.l_suppkey, b.l_suppkey) AS high FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_suppkey <> b.l_suppkey
""")
def opponent_edges(t: Tables) -> DataFrame:
    return relational.opponent_edges(t.lineitem, "l_orderkey", "l_linenumber", "l_suppkey")


@query("""
WITH RECURSIVE u AS (
  SELECT DISTINCT a.l_suppkey AS x, b.l_suppkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey
), r(node, component) USING KEY (node) AS (
  SELECT x, min(least(x, y)) FROM u GROUP BY x UNION
  SELECT u.y, min(q.component) FROM recurring.r q JOIN u ON u.x = q.node JOIN recurring.r o ON o.node = u.y WHERE q.component < o.component GROUP BY u.y)
SELECT node, component FROM r
""")
def connected_components(t: Tables) -> DataFrame:
    edges = relational.opponent_edges(t.lineitem, "l_orderkey", "l_linenumber", "l_suppkey")
    return graph.components(edges.select(F.col("low").alias("a"), F.col("high").alias("b")))


@query()
def bridge_edges(t: Tables) -> DataFrame:
    """Every edge, and whether it is a bridge: the whole graph may have none."""
    edges = graph.checkpointed(relational.opponent_edges(t.lineitem, "l_orderkey", "l_linenumber", "l_suppkey").select(F.col("low").alias("a"), F.col("high").alias("b")))
    found = graph.bridges(edges).withColumn("bridge", F.lit(True))
    return edges.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("bridge", F.lit(False)).alias("bridge"))


@query("""
SELECT l_orderkey, min_by(l_extendedprice, struct_pack(a := l_linenumber, b := l_partkey)) AS value_a, max_by(l_extendedprice, struct_pack(a := l_linenumber, b := l_partkey)) AS value_b FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2
""")
def pairs_of_two(t: Tables) -> DataFrame:
    return relational.pairs_of_two(t.lineitem.withColumn("side", F.struct("l_linenumber", "l_partkey")), "l_orderkey", "side", "l_extendedprice")


@query("""
WITH n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, a.l_quantity - b.l_quantity AS difference FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND a.i <> b.i WHERE a.n = 2
""")
def own_minus_other(t: Tables) -> DataFrame:
    return relational.own_minus_other(t.lineitem, "l_orderkey", "l_linenumber", "l_quantity")


@query("""
WITH s AS (SELECT l_suppkey, sum(l_quantity) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS v FROM lineitem GROUP BY 1),
a AS (SELECT l_suppkey FROM s ORDER BY q DESC, l_suppkey LIMIT 20), b AS (SELECT l_suppkey FROM s ORDER BY v DESC, l_suppkey LIMIT 20)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either,
(SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b,
(SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS jaccard
""")
def top_set_overlap(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("v"))
    return relational.top_set_overlap(s.withColumnRenamed("q", "score"), s.withColumnRenamed("v", "score"), "l_suppkey", "score", 20)


@query("""
WITH a AS (SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT coalesce(a.flag, b.flag) AS flag, a.n AS count_a, b.n AS count_b FROM a FULL JOIN b ON a.flag = b.flag WHERE a.n IS DISTINCT FROM b.n
""")
def differing_counts(t: Tables) -> DataFrame:
    n = lambda s: t.lineitem.filter(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    return relational.differing_counts(n("O"), n("F"), "flag", "n")


@query("""
SELECT DISTINCT user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE value > 95 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
""")
def set_union(t: Tables) -> DataFrame:
    a = t.events.filter("event_type = 'purchase'").select("user_id")
    return a.union(t.events.filter("value > 95").select("user_id")).union(t.orders.filter("o_totalprice > 400000").select("o_custkey")).distinct()


@query("""
WITH k AS (SELECT l_partkey, l_suppkey FROM lineitem), w AS (SELECT s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
SELECT c_custkey, c_name, coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey FROM customer LEFT JOIN supplier a ON replace(c_name, 'Customer', 'Supplier') = a.s_name
LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1) b ON b.s_nationkey = c_nationkey
""")
def two_step_lookup(t: Tables) -> DataFrame:
    asked = t.customer.withColumn("asked", F.regexp_replace("c_name", "Customer", "Supplier"))
    return relational.two_step_lookup(asked, t.supplier, ("asked", "s_name"), ("c_nationkey", "s_nationkey"), "s_suppkey").select("c_custkey", "c_name", "s_suppkey")


@query("""
SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) + 30
""")
def key_list_membership(t: Tables) -> DataFrame:
    urgent = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    near = F.to_date("l_shipdate") < F.date_add(F.to_date("o_orderdate"), 30)
    return urgent.join(t.lineitem, (F.col("l_orderkey") == F.col("o_orderkey")) & near).select("o_orderkey", "l_linenumber")
