"""Queries of credit, expectation and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talweg.catalog import Tables
from talweg.functions import ordinal
from talweg.operators import credit, windows
from talweg.plans.registry import query


@query("""
WITH v AS (SELECT l_orderkey, l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS value, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, value / sum(value) OVER (PARTITION BY l_orderkey) AS weight, avg(q) OVER () AS mean_q FROM v),
c AS (SELECT l_suppkey, weight * (CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 ELSE 0.5 END - 1 / (1 + exp(-ln(q / mean_q)))) AS credit FROM s JOIN orders ON o_orderkey = l_orderkey),
t AS (SELECT l_suppkey, count(*) AS n, round(sum(credit), 6) AS credit FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY credit DESC, l_suppkey) AS rank FROM t)
SELECT l_suppkey, n, credit, rank, n >= 3 AS headline FROM r
""")
def actor_credit_ranking(t: Tables) -> DataFrame:
    value = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"), F.sum("l_quantity").alias("q"))
    mean = value.agg(F.avg("q").alias("mean"))  # one row
    share = windows.with_share(value, ["l_orderkey"], "value").join(F.broadcast(mean), F.lit(True))
    score = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).otherwise(0.5)
    told = share.join(t.orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") == F.col("l_orderkey"))
    totals = told.withColumn("c", F.col("share") * (score - ordinal.sigmoid(F.log(F.col("q") / F.col("mean"))))).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("c"), 6).alias("credit"))
    return credit.ranking(totals, "l_suppkey", "credit", "n", 3).select("l_suppkey", "n", "credit", "rank", "headline")


_ROLE = "CASE l_linenumber WHEN 1 THEN 'field' WHEN 2 THEN 'supreme' WHEN 3 THEN 'subordinate' WHEN 4 THEN 'theatre' WHEN 5 THEN 'nominal' WHEN 6 THEN 'field' END"


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_ROLE} AS role FROM lineitem),
f AS (SELECT *, CASE role WHEN 'supreme' THEN 0.10 WHEN 'subordinate' THEN 0.08 WHEN 'theatre' THEN 0.10 WHEN 'nominal' THEN 0.05 ELSE 0 END AS fixed FROM r),
w AS (SELECT *, count(*) OVER p AS n, count(*) FILTER (role = 'field') OVER p AS leads, count(role) OVER p AS known, sum(fixed) OVER p AS total FROM f WINDOW p AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN 'single' WHEN leads > 0 AND known = n THEN 'rule' ELSE 'default_split' END AS method,
round(CASE WHEN n = 1 THEN 1.0 WHEN leads > 0 AND known = n THEN CASE WHEN role = 'field' THEN (1 - total * least(1, coalesce(0.3 / nullif(total, 0), 1))) / leads ELSE fixed * least(1, coalesce(0.3 / nullif(total, 0), 1)) END ELSE 1.0 / n END, 9) AS weight FROM w
""")
def role_weights(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    role = F.when(n.isin(1, 6), "field").when(n == 2, "supreme").when(n == 3, "subordinate").when(n == 4, "theatre").when(n == 5, "nominal")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", role.alias("role"))
    out = credit.side_weights(rows, ["l_orderkey"], "l_linenumber", "role")
    return out.select("l_orderkey", "l_linenumber", "method", F.round("weight", 9).alias("weight"))


_ETA = "ln(l_quantity / 25.5)"


@query(f"""
WITH e AS (SELECT l_orderkey, l_linenumber, {_ETA} AS eta FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1 - 1 / (1 + exp(-(0.4 - eta))), 9) AS win, round(1 / (1 + exp(-(-0.4 - eta))), 9) AS loss, round(1 - 0.5 * (1 / (1 + exp(-(0.4 - eta))) + 1 / (1 + exp(-(-0.4 - eta)))), 9) AS expected,
round(1 / (1 + exp(-(-1.2 - eta))), 9) AS p0, round(1 - 1 / (1 + exp(-(1.2 - eta))), 9) AS p4, round(1 - 1 / (1 + exp(-(-0.4 - eta))), 9) AS even_or_better FROM e
""")
def ordinal_scores(t: Tables) -> DataFrame:
    eta = F.log(F.col("l_quantity") / 25.5)
    p = ordinal.category_probs(eta, 0.4, 1.2)
    o = ordinal.outcome_probs(eta, 0.4)
    up = ordinal.interval_probability(eta, F.lit(2), F.lit(4), 0.4, 1.2)
    return t.lineitem.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(n) for n, c in (("win", o["win"]), ("loss", o["loss"]), ("expected", ordinal.expected_score(eta, 0.4)), ("p0", F.element_at(p, 1)), ("p4", F.element_at(p, 5)), ("even_or_better", up))])


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN CAST(l_linenumber % 5 AS INTEGER) END AS a, CASE WHEN l_discount > 0.02 THEN CAST(l_partkey % 5 AS INTEGER) END AS b FROM lineitem), m AS (SELECT *, 4 - b AS c FROM r),
x AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 'no_outcome' WHEN a IS NOT NULL AND b IS NOT NULL AND sign(a - 2) <> sign(c - 2) THEN 'conflict' END AS reason FROM m)
SELECT l_orderkey, l_linenumber, CASE WHEN reason IS NULL THEN least(a, c) END AS k_lo, CASE WHEN reason IS NULL THEN greatest(a, c) END AS k_hi, reason,
CAST(CASE WHEN reason IS NULL THEN CASE WHEN least(a, c) >= 3 THEN 1.0 WHEN greatest(a, c) <= 1 THEN 0.0 ELSE 0.5 END END AS DOUBLE) AS score FROM x
""")
def outcome_intervals(t: Tables) -> DataFrame:
    a = F.when(F.col("l_quantity") > 10, (F.col("l_linenumber") % 5).cast("int"))
    b = F.when(F.col("l_discount") > 0.02, (F.col("l_partkey") % 5).cast("int"))
    o = t.lineitem.select("l_orderkey", "l_linenumber", ordinal.outcome_interval(a, b).alias("o"))
    return o.select("l_orderkey", "l_linenumber", "o.k_lo", "o.k_hi", "o.reason", ordinal.score_of_interval(F.col("o.k_lo"), F.col("o.k_hi")).alias("score"))


@query("SELECT l_linenumber, round(quantile_cont(l_quantity / 10, 0.4), 9) AS replacement FROM lineitem GROUP BY 1")
def replacement_level(t: Tables) -> DataFrame:
    skills = t.lineitem.withColumn("skill", F.col("l_quantity") / 10)
    return credit.replacement_level(skills, ["l_linenumber"], "skill").withColumn("replacement", F.round("replacement", 9))


@query("""
WITH s AS (SELECT l_linenumber AS draw, l_suppkey, l_orderkey, l_quantity / 10 AS skill, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS weight, CASE l_linestatus WHEN 'F' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
r AS (SELECT draw, quantile_cont(skill, 0.4) AS rep FROM s GROUP BY 1), e AS (SELECT *, weight * skill AS part, ln(skill + 0.1) AS eta FROM s JOIN r USING (draw)),
x AS (SELECT *, 1 - 0.5 * (1 / (1 + exp(-(0.4 - eta))) + 1 / (1 + exp(-(-0.4 - eta)))) AS fit, 1 - 0.5 * (1 / (1 + exp(-(0.4 - (eta - part + weight * rep)))) + 1 / (1 + exp(-(-0.4 - (eta - part + weight * rep))))) AS gone FROM e)
SELECT draw, l_suppkey, round(sum(fit - gone), 6) AS expected, round(sum(weight * (y - fit) + (fit - gone)), 6) AS realised, count(*) AS n FROM x GROUP BY 1, 2
""")
def credit_totals(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    s = t.lineitem.select(F.col("l_linenumber").alias("draw"), "l_suppkey", "l_orderkey", (F.col("l_quantity") / 10).alias("skill"), (F.col("l_extendedprice") / F.sum("l_extendedprice").over(w)).alias("weight"), (F.col("l_linestatus") == "F").cast("double").alias("y"))
    e = s.join(credit.replacement_level(s, ["draw"], "skill"), "draw").withColumn("part", F.col("weight") * F.col("skill")).withColumn("eta", F.log(F.col("skill") + 0.1))
    out = credit.credit(e, ["draw"], "l_suppkey", "weight", "weight", "part", "eta", "y", "replacement", 0.4)
    return out.select("draw", "l_suppkey", F.round("expected", 6).alias("expected"), F.round("realised", 6).alias("realised"), "n")


@query("""
WITH p AS (SELECT l_linestatus, l_linenumber % 5 AS k, ln(l_quantity / 25.5) AS eta FROM lineitem), c AS (SELECT l_linestatus, k, 1 / (1 + exp(-(-1.2 - eta))) AS a, 1 / (1 + exp(-(-0.4 - eta))) AS b, 1 / (1 + exp(-(0.4 - eta))) AS c, 1 / (1 + exp(-(1.2 - eta))) AS d FROM p)
SELECT l_linestatus, round(avg((power(a - CASE WHEN k <= 0 THEN 1 ELSE 0 END, 2) + power(b - CASE WHEN k <= 1 THEN 1 ELSE 0 END, 2) + power(c - CASE WHEN k <= 2 THEN 1 ELSE 0 END, 2) + power(d - CASE WHEN k <= 3 THEN 1 ELSE 0 END, 2)) / 4), 9) AS rps,
round(avg(ln(greatest(CASE k WHEN 0 THEN a WHEN 1 THEN b - a WHEN 2 THEN c - b WHEN 3 THEN d - c ELSE 1 - d END, 1e-12))), 9) AS log_score FROM c GROUP BY 1
""")
def probability_scores(t: Tables) -> DataFrame:
    eta, k = F.log(F.col("l_quantity") / 25.5), (F.col("l_linenumber") % 5).cast("int")
    rps = ordinal.ranked_probability_score(ordinal.category_probs(eta, 0.4, 1.2), k)
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.avg(rps), 9).alias("rps"), F.round(F.avg(ordinal.log_likelihood(eta, k, k, 0.4, 1.2)), 9).alias("log_score"))


@query("""
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'casualties' WHEN 1 THEN 'troop_total' WHEN 2 THEN 'terrain' ELSE 'battle_type' END AS field, CASE WHEN o_orderkey % 9 > 0 THEN CAST(1400 + o_orderkey % 600 AS INTEGER) END AS y,
o_totalprice > 150000 AS own, o_orderpriority < '3' AS other, o_orderstatus = 'F' AS lost, o_custkey % 50 = 0 AS closed FROM orders)
SELECT o_orderkey, CASE WHEN y IS NULL THEN NULL WHEN field IN ('terrain', 'battle_type') THEN 'mar' WHEN closed THEN 'mnar' WHEN field = 'casualties' AND own THEN CASE WHEN lost THEN 'mnar' ELSE 'mar' END WHEN y < 1500 AND NOT (own OR other) THEN 'mnar'
WHEN lost AND NOT own AND other THEN 'mnar' WHEN y BETWEEN 1700 AND 1914 AND NOT own AND other THEN 'mar' END AS missingness FROM r
""")
def missingness_rules(t: Tables) -> DataFrame:
    o = t.orders
    n = F.col("o_orderkey") % 4
    field = F.when(n == 0, "casualties").when(n == 1, "troop_total").when(n == 2, "terrain").otherwise("battle_type")
    year = F.when(F.col("o_orderkey") % 9 > 0, (1400 + F.col("o_orderkey") % 600).cast("int"))
    own, other = F.col("o_totalprice") > 150000, F.col("o_orderpriority") < "3"
    label = credit.missing_class(field, year, own, other, own | other, F.col("o_orderstatus") == "F", F.col("o_custkey") % 50 == 0, ["terrain", "battle_type"])
    return o.select("o_orderkey", label.alias("missingness"))


@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-7'), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def fold_assignment(t: Tables) -> DataFrame:
    """Five folds by a stable hash: sizes differ by one at most within each source of order. Ranks are taken in 4,096 splits of the hash."""
    keyed = t.orders.select("o_orderkey", F.coalesce("o_orderpriority", F.lit("")).alias("part"), F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("-7"))).alias("h"))
    keyed = keyed.withColumn("split", F.substring("h", 1, 3))
    before = Window.partitionBy("part").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ahead = keyed.groupBy("part", "split").agg(F.count("*").alias("n")).select("part", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = keyed.withColumn("place", F.row_number().over(Window.partitionBy("part", "split").orderBy("h", "o_orderkey")))
    return within.join(ahead, ["part", "split"]).select("o_orderkey", ((F.col("ahead") + F.col("place") - 1) % 5).cast("int").alias("fold"))
