"""Queries of statistics over draws, classification and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talweg.catalog import Tables
from talweg.functions import parse
from talweg.operators import classify, stats
from talweg.plans.registry import query


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN l_quantity + 2.5 ELSE l_quantity END AS value FROM lineitem")
def missing_shift(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", stats.shifted_if_missing(F.col("l_quantity"), F.col("l_returnflag") == "R", F.col("l_discount") > 0.05, 2.5).alias("value"))


@query("SELECT o_orderkey, round((ln(o_totalprice) + ln(o_totalprice * (1 + o_orderkey % 3))) / 2, 9) AS mean, round(CASE WHEN o_orderkey % 3 > 0 THEN (ln(o_totalprice * (1 + o_orderkey % 3)) - ln(o_totalprice)) / 3.92 ELSE 0.5 END, 9) AS sd FROM orders")
def published_likelihoods(t: Tables) -> DataFrame:
    p = stats.published_likelihood(F.col("o_totalprice"), F.col("o_totalprice") * (1 + F.col("o_orderkey") % 3), 0.5)
    return t.orders.select("o_orderkey", F.round(p["mean"], 9).alias("mean"), F.round(p["sd"], 9).alias("sd"))


@query("""
WITH s AS (SELECT o_orderkey, o_orderpriority AS era, CASE WHEN o_orderkey % 4 > 0 AND o_orderpriority <> '5-LOW' THEN o_totalprice END AS own FROM orders)
SELECT o_orderkey, round(coalesce(own, avg(own) OVER (PARTITION BY era), avg(own) OVER (), 0), 4) AS filled FROM s
""")
def filled_slopes(t: Tables) -> DataFrame:
    weak = (F.col("o_orderkey") % 4 == 0) | (F.col("o_orderpriority") == "5-LOW")
    return stats.filled_slopes(t.orders, "o_totalprice", weak, "o_orderpriority").select("o_orderkey", F.round("filled", 4).alias("filled"))


@query("""
WITH d AS (SELECT l_suppkey, l_linenumber AS draw, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), m AS (SELECT l_suppkey, round(avg(v), 9) AS m FROM d GROUP BY 1), r AS (SELECT l_suppkey, row_number() OVER (ORDER BY m DESC, l_suppkey) AS rank FROM m),
n AS (SELECT a.l_suppkey, b.l_suppkey AS nxt FROM r a LEFT JOIN r b ON b.rank = a.rank + 1)
SELECT n.l_suppkey, round(avg(CASE WHEN b.v IS NOT NULL THEN CAST(a.v > b.v AS INTEGER) END), 9) AS p_next FROM n JOIN d a ON a.l_suppkey = n.l_suppkey LEFT JOIN d b ON b.l_suppkey = n.nxt AND b.draw = a.draw GROUP BY 1
""")
def order_probabilities(t: Tables) -> DataFrame:
    from talweg.operators.windows import ranked_descending

    d = t.lineitem.groupBy("l_suppkey", F.col("l_linenumber").alias("draw")).agg(F.avg("l_quantity").alias("v"))
    ranking = ranked_descending(d.groupBy("l_suppkey").agg(F.round(F.avg("v"), 9).alias("m")), "m", "l_suppkey")
    return stats.order_probability(d, ranking, "draw", "l_suppkey", "v").withColumn("p_next", F.round("p_next", 9))


@query("SELECT round((v - 2 * n) / v, 9) AS reliability FROM (SELECT avg(power(ln(l_quantity / 25), 2)) AS v, avg(l_tax * l_tax) * 4.0 / 2 AS n FROM lineitem)")
def implied_reliability(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.log(F.col("l_quantity") / 25).alias("r"), (F.col("l_tax") * F.col("l_tax")).alias("v"))
    return stats.reliability(rows, "r", "v", 4.0).withColumn("reliability", F.round("reliability", 9))


@query("""
WITH h AS (SELECT l_returnflag, l_linenumber, l_quantity, ntile(2) OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity) AS h FROM lineitem), p AS (SELECT l_returnflag, l_linenumber, h, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM h GROUP BY 1, 2, 3),
s AS (SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS draws, avg(n) AS n, avg(v) AS w, var_samp(m) AS b FROM p GROUP BY 1) SELECT l_returnflag, draws, round(sqrt(((n - 1) / n * w + b) / w), 9) AS rhat FROM s
""")
def split_rhat(t: Tables) -> DataFrame:
    d = t.lineitem.withColumn("at", F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"))
    return stats.split_rhat(d, ["l_returnflag"], "l_linenumber", "at", "l_quantity").withColumn("rhat", F.round("rhat", 9))


@query("""
WITH p AS (SELECT l_suppkey, sum(l_extendedprice / power(l_quantity, 2)) / sum(1 / power(l_quantity, 2)) AS mean, 1 / sum(1 / power(l_quantity, 2)) AS noise FROM lineitem GROUP BY 1), w AS (SELECT avg(mean) AS m, greatest(coalesce(var_samp(mean), 0) - avg(noise), 0) AS t FROM p)
SELECT l_suppkey, round(mean, 4) AS mean, round(t / (t + noise) * mean + (1 - t / (t + noise)) * m, 4) AS shrunk, round(sqrt(t / (t + noise) * noise), 4) AS sd FROM p, w
""")
def shrunk_means(t: Tables) -> DataFrame:
    out = stats.shrunk_means(t.lineitem, ["l_suppkey"], "l_extendedprice", "l_quantity")
    return out.select("l_suppkey", *[F.round(c, 4).alias(c) for c in ("mean", "shrunk", "sd")])


@query()
def normal_mixture(t: Tables) -> DataFrame:
    x = t.orders.select(F.log("o_totalprice").alias("x"))
    fit = stats.normal_mixture(x, "x", 40)
    return x.select(stats.responsibility(F.col("x"), fit).alias("r")).agg(F.round(F.avg("r"), 3).alias("weight"))


@query()
def conditional_draws(t: Tables) -> DataFrame:
    sides = t.lineitem.select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("side"), F.lit(3.0).alias("mean"), F.when(F.col("l_returnflag") != "R", F.log("l_quantity")).alias("known"))
    return stats.conditional_draws(sides, "l_orderkey", "side", "mean", "known", 0.5, 0.8, 4, 11)


@query()
def stratified_draws(t: Tables) -> DataFrame:
    return stats.stratified_pick(t.supplier, "s_acctbal", "s_suppkey", 10, 3)


@query("""
WITH e AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Siege of ' || p_name WHEN 1 THEN 'Battle of ' || p_name WHEN 2 THEN 'Operation ' || p_name WHEN 3 THEN p_name || ' war' WHEN 4 THEN 'Conquest of ' || p_name ELSE p_name || ' affair' END AS title, p_size * 40 AS days, CASE WHEN p_partkey % 17 = 0 THEN 'decade' ELSE 'day' END AS prec FROM part), l AS (SELECT *, lower(title) AS low FROM e),
x AS (SELECT *, NOT regexp_matches(low, '\\b(battle|siege|skirmish|raid)\\b') AS plain FROM l)
SELECT p_partkey, CASE WHEN prec IN ('decade', 'century') THEN 'date_precision' WHEN plain AND regexp_matches(low, '^operation\\b') THEN 'operation' WHEN plain AND regexp_matches(low, '\\b(war|wars|crisis|campaign|campaigns)\\b') THEN 'wider_conflict' WHEN plain AND regexp_matches(low, '\\b(invasion|conquest) of\\b') THEN 'conquest'
WHEN regexp_matches(low, '\\bsiege\\b') AND days > 730 THEN 'long_siege' WHEN NOT regexp_matches(low, '^(battle|siege) of\\b') AND days > 180 THEN 'long_span' END AS reason FROM x
""")
def campaign_rules(t: Tables) -> DataFrame:
    n, name = F.col("p_partkey") % 6, F.col("p_name")
    title = F.when(n == 0, F.concat(F.lit("Siege of "), name)).when(n == 1, F.concat(F.lit("Battle of "), name)).when(n == 2, F.concat(F.lit("Operation "), name)).when(n == 3, F.concat(name, F.lit(" war"))).when(n == 4, F.concat(F.lit("Conquest of "), name)).otherwise(F.concat(name, F.lit(" affair")))
    precision = F.when(F.col("p_partkey") % 17 == 0, "decade").otherwise("day")
    return t.part.select("p_partkey", classify.campaign_reason(title, F.col("p_size") * 40, precision).alias("reason"))


@query()
def text_quantities(t: Tables) -> DataFrame:
    return parse.text_quantities(t.documents, "doc_id", "text")


@query()
def article_passages(t: Tables) -> DataFrame:
    return parse.passages(t.documents, "doc_id", "text", 800, 40)
