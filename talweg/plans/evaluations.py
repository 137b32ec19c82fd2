"""Queries of evaluation and reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.catalog import Tables
from talweg.operators import evaluation, relational, windows
from talweg.plans.registry import query

_VALUES = "SELECT l_linenumber AS round, l_orderkey AS event, l_suppkey AS side, ln(l_extendedprice) AS v, l_returnflag = 'R' AS imputed, CASE WHEN l_returnflag <> 'R' THEN ln(l_quantity) END AS report, l_linestatus AS era FROM lineitem"


def _values(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_linenumber").alias("round"), F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("side"), F.log("l_extendedprice").alias("v"), (F.col("l_returnflag") == "R").alias("imputed"), F.when(F.col("l_returnflag") != "R", F.log("l_quantity")).alias("report"), F.col("l_linestatus").alias("era"))


@query(f"""
WITH v AS ({_VALUES}), p AS (SELECT round, event % 500 AS event, max(v) - min(v) AS span, count(*) AS n, bool_or(imputed) AS hit FROM v GROUP BY 1, 2), m AS (SELECT event, quantile_cont(span, 0.5) AS median FROM p WHERE n >= 2 AND hit GROUP BY 1)
SELECT count(*) AS events, round(max(median), 9) AS largest, count(*) = 0 OR max(median) < 4 AS passed FROM m
""")
def ratio_plausible(t: Tables) -> DataFrame:
    v = _values(t).withColumn("event", F.col("event") % 500)
    return evaluation.ratio_plausible(v, "round", "event", "v", "imputed").withColumn("largest", F.round("largest", 9))


@query(f"WITH v AS ({_VALUES}) SELECT count(*) AS n, count(*) FILTER (NOT exp(v) BETWEEN 1000.5 AND 100000.5) AS outside, count(*) FILTER (NOT exp(v) BETWEEN 1000.5 AND 100000.5) = 0 AS passed FROM v WHERE imputed")
def values_plausible(t: Tables) -> DataFrame:
    return evaluation.values_plausible(_values(t), "v", F.col("imputed"), 1000.5, 100000.5)


@query(f"WITH v AS ({_VALUES}) SELECT count(*) AS sides, round(regr_slope(v, report), 9) AS slope, count(*) < 10 OR regr_slope(v, report) >= 0.9 AS passed FROM v WHERE report IS NOT NULL")
def side_slope(t: Tables) -> DataFrame:
    return evaluation.side_slope(_values(t), "v", "report").withColumn("slope", F.round("slope", 9))


@query()
def distribution_by_era(t: Tables) -> DataFrame:
    return evaluation.distributional(_values(t), "round", "era", "v", F.col("imputed"))


@query("""
WITH s AS (SELECT l_suppkey, sum(l_quantity) AS a, round(sum(l_extendedprice), 2) AS b FROM lineitem GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM s),
x AS (SELECT l_suppkey FROM s ORDER BY a DESC, l_suppkey LIMIT 30), y AS (SELECT l_suppkey FROM s ORDER BY b DESC, l_suppkey LIMIT 30), j AS (SELECT x.l_suppkey AS p, y.l_suppkey AS q FROM x FULL JOIN y ON x.l_suppkey = y.l_suppkey)
SELECT count(*) FILTER (p IS NOT NULL AND q IS NOT NULL) AS shared, count(*) AS either, count(*) FILTER (q IS NULL) AS only_a, count(*) FILTER (p IS NULL) AS only_b, count(*) FILTER (p IS NOT NULL AND q IS NOT NULL) / count(*) AS jaccard, (SELECT count(*) FROM r) AS n, (SELECT round(corr(ra, rb), 9) FROM r) AS rho FROM j
""")
def rank_agreement(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("a"), F.round(F.sum("l_extendedprice"), 2).alias("b"))
    return evaluation.rank_agreement(s.select("l_suppkey", F.col("a").alias("score")), s.select("l_suppkey", F.col("b").alias("score")), "l_suppkey", "score", 30).withColumn("rho", F.round("rho", 9))


@query("SELECT l_suppkey, round(sum(CASE WHEN l_quantity < 10 THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 9) AS share FROM lineitem WHERE l_suppkey % 4 = 0 GROUP BY 1 HAVING sum(CASE WHEN l_quantity < 10 THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice) > 0.18")
def extreme_dependence(t: Tables) -> DataFrame:
    top = t.supplier.filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return evaluation.concentration(t.lineitem, "l_suppkey", "l_extendedprice", F.col("l_quantity") < 10, top, 0.18).withColumn("share", F.round("share", 9))


@query("""
WITH w AS (SELECT c_custkey, CAST(1 + c_custkey % 40 AS INTEGER) AS low, CAST(400 + c_custkey % 90 AS INTEGER) AS high FROM customer WHERE c_custkey % 10 = 0), r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer WHERE c_custkey % 3 > 0)
SELECT w.c_custkey, low, high, rank, CASE WHEN rank IS NULL THEN 'not_evaluable' WHEN rank BETWEEN low AND high THEN 'passed' ELSE 'failed' END AS status FROM w LEFT JOIN r ON r.c_custkey = w.c_custkey
""")
def expert_checks(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    wanted = t.customer.filter(k % 10 == 0).select(k, (1 + k % 40).cast("int").alias("low"), (400 + k % 90).cast("int").alias("high"))
    ranking = windows.ranked_descending(t.customer.filter(k % 3 > 0).select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")
    return evaluation.expert_checks(wanted, ranking, "c_custkey")


@query("""
WITH a AS (SELECT c_custkey, c_mktsegment, n_name, count(o_orderkey) AS n, count(DISTINCT o_orderpriority) AS kinds FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3) SELECT * FROM a ORDER BY n DESC, c_custkey LIMIT 50
""")
def actor_summary(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("kinds"))
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(n, "c_custkey", "left")
    return j.select("c_custkey", "c_mktsegment", "n_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kinds", F.lit(0)).alias("kinds")).orderBy(F.desc("n"), "c_custkey").limit(50)


@query("SELECT event_id, user_id, substr(props, 1, 8) AS props FROM events WHERE value IS NOT NULL AND event_type ILIKE '%a%' ORDER BY ts DESC, event_id LIMIT 40")
def newest_matching(t: Tables) -> DataFrame:
    hits = t.events.filter(F.col("value").isNotNull() & F.col("event_type").ilike("%a%"))
    return hits.orderBy(F.desc("ts"), "event_id").limit(40).select("event_id", "user_id", F.substring("props", 1, 8).alias("props"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) >= 1995")
def optional_year_range(t: Tables) -> DataFrame:
    return relational.year_range(t.orders.withColumn("y", F.year("o_orderdate")), "y", 1995, None).select("o_orderkey", "o_totalprice")


@query("SELECT CAST(floor(ln(h / l) * 4) AS BIGINT) AS bin, count(*) AS n FROM (SELECT min(l_extendedprice) AS l, max(l_extendedprice) AS h FROM lineitem GROUP BY l_orderkey) WHERE l > 0 GROUP BY 1")
def interval_width_histogram(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("l"), F.max("l_extendedprice").alias("h")).filter("l > 0")
    return s.groupBy(F.floor(F.log(F.col("h") / F.col("l")) * 4).alias("bin")).agg(F.count("*").alias("n"))
