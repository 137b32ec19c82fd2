"""Queries of aggregations, bins and pooled statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.catalog import TABLES, Tables
from talweg.functions.maths import floor_bin, wilson
from talweg.operators import aggregates, windows
from talweg.plans.registry import query


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("""
SELECT l_orderkey, l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS sd, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
round(CASE WHEN avg(l_extendedprice) > 0 THEN stddev_samp(l_extendedprice) / avg(l_extendedprice) END, 6) AS cv FROM lineitem GROUP BY 1, 2
""")
def claim_agreement(t: Tables) -> DataFrame:
    return _rounded(aggregates.agreement(t.lineitem, ["l_orderkey", "l_returnflag"], "l_extendedprice"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def role_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT o_orderkey, count(l_linenumber) AS n, round(sum(l_quantity), 4) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def group_sums(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n"), F.round(F.sum("l_quantity"), 4).alias("total"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def missingness_matrix(t: Tables) -> DataFrame:
    wide = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("""
SELECT CASE WHEN l_discount = 0 THEN 'none' WHEN l_discount < 0.05 THEN 'low' ELSE 'high' END AS label, count(*) AS n FROM lineitem GROUP BY 1
""")
def labelled_counts(t: Tables) -> DataFrame:
    label = F.when(F.col("l_discount") == 0, "none").when(F.col("l_discount") < 0.05, "low").otherwise("high")
    return t.lineitem.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def daily_counts(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date(F.date_trunc("day", "ts")).alias("day")).agg(F.count("*").alias("n"))


@query("SELECT CAST(floor(c_acctbal / 500.0) * 500 AS BIGINT) AS bin, count(*) AS n FROM customer GROUP BY 1")
def floor_histogram(t: Tables) -> DataFrame:
    return t.customer.groupBy(floor_bin(F.col("c_acctbal"), 500).alias("bin")).agg(F.count("*").alias("n"))


@query("""
WITH j AS (SELECT * FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON o_custkey = c_custkey), n AS (SELECT count(*) AS n FROM j)
SELECT 'c_name' AS "column", (SELECT count(*) FROM j WHERE c_name IS NULL) AS n_null, n, (SELECT count(*) FROM j WHERE c_name IS NULL) / n AS fraction FROM n UNION ALL
SELECT 'o_orderkey', (SELECT count(*) FROM j WHERE o_orderkey IS NULL), n, (SELECT count(*) FROM j WHERE o_orderkey IS NULL) / n FROM n UNION ALL
SELECT 'o_totalprice', (SELECT count(*) FROM j WHERE o_totalprice IS NULL), n, (SELECT count(*) FROM j WHERE o_totalprice IS NULL) / n FROM n
""")
def null_fractions(t: Tables) -> DataFrame:
    j = t.customer.join(t.orders.filter("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return aggregates.null_fractions(j, ["c_name", "o_orderkey", "o_totalprice"])


@query("SELECT event_type, count(DISTINCT user_id) FILTER (value > 50) AS hits, count(DISTINCT user_id) AS n, count(DISTINCT user_id) FILTER (value > 50) / count(DISTINCT user_id) AS share FROM events GROUP BY 1")
def filtered_distinct_share(t: Tables) -> DataFrame:
    return aggregates.filtered_distinct_share(["event_type"], t.events, "user_id", F.col("value") > 50)


@query("""
SELECT CASE WHEN n = 0 THEN '0' WHEN n < 5 THEN '1-4' WHEN n < 15 THEN '5-14' ELSE '15+' END AS bin, count(*) AS customers, count(*) FILTER (c_acctbal > 0) AS in_credit
FROM (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1
""")
def fame_bins(t: Tables) -> DataFrame:
    n = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_acctbal").agg(F.count("o_orderkey").alias("n"))
    label = F.when(F.col("n") == 0, "0").when(F.col("n") < 5, "1-4").when(F.col("n") < 15, "5-14").otherwise("15+")
    return n.groupBy(label.alias("bin")).agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") > 0).alias("in_credit"))


@query("SELECT l_suppkey, CAST(min(year(l_shipdate)) AS INTEGER) AS first_year, CAST(max(year(l_shipdate)) AS INTEGER) AS last_year, CAST(max(year(l_shipdate)) - min(year(l_shipdate)) AS INTEGER) AS span FROM lineitem GROUP BY 1")
def career_spans(t: Tables) -> DataFrame:
    y = F.year("l_shipdate")
    return t.lineitem.groupBy("l_suppkey").agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"), (F.max(y) - F.min(y)).alias("span"))


@query("SELECT l_suppkey, l_returnflag, round(sum(coalesce(nullif(l_discount, 0), l_tax, 0)), 6) AS credit FROM lineitem GROUP BY 1, 2")
def credit_by_method(t: Tables) -> DataFrame:
    credit = F.coalesce(F.nullif(F.col("l_discount"), F.lit(0.0)), F.col("l_tax"), F.lit(0.0))
    return t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.round(F.sum(credit), 6).alias("credit"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity > 45 GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2")
def having_distinct(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_quantity > 45").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts")).filter("parts >= 2")


@query("""
SELECT l_orderkey, round(median, 6) AS median, round(quantile_cont(abs(l_extendedprice - median), 0.5), 6) AS mad FROM (SELECT *, quantile_cont(l_extendedprice, 0.5) OVER (PARTITION BY l_orderkey) AS median FROM lineitem) GROUP BY 1, median
""")
def median_absolute_deviation(t: Tables) -> DataFrame:
    return _rounded(aggregates.median_abs_deviation(t.lineitem, ["l_orderkey"], "l_extendedprice"))


@query("SELECT l_returnflag, round(quantile_cont(ln(l_extendedprice / l_quantity), 0.5), 9) AS median_log, round(coalesce(min(ln(l_extendedprice / l_quantity)), 1000), 9) AS least_log FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def log_width_quantiles(t: Tables) -> DataFrame:
    x = F.log(F.col("l_extendedprice") / F.col("l_quantity"))
    return t.lineitem.filter("l_quantity > 0").groupBy("l_returnflag").agg(F.round(F.percentile(x, F.lit(0.5)), 9).alias("median_log"), F.round(F.coalesce(F.min(x), F.lit(1000.0)), 9).alias("least_log"))


@query("SELECT l_suppkey, round(sum(l_quantity * l_extendedprice) / nullif(sum(l_quantity), 0), 4) AS mean, round(sum(l_quantity), 4) AS weight, count(*) AS n FROM lineitem GROUP BY 1")
def precision_weighted(t: Tables) -> DataFrame:
    return _rounded(aggregates.combined(t.lineitem, ["l_suppkey"], "l_extendedprice", "l_quantity"), 4)


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) AS through_origin, round(CASE WHEN count(*) >= 3 THEN regr_slope(l_extendedprice, l_quantity) END, 6) AS ols, round(exp(avg(ln(l_extendedprice) - ln(l_quantity))), 6) AS ratio, round(stddev_pop(l_extendedprice) / stddev_pop(l_quantity), 6) AS spread FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def slopes_and_ratios(t: Tables) -> DataFrame:
    x, y = "l_quantity", "l_extendedprice"
    aggs = {"through_origin": aggregates.slope_through_origin(x, y), "ols": aggregates.ols_slope(x, y), "ratio": aggregates.geometric_ratio(y, x), "spread": aggregates.spread_ratio(y, x)}
    return t.lineitem.filter("l_quantity > 0").groupBy("l_returnflag").agg(*[F.round(c, 6).alias(n) for n, c in aggs.items()])


@query("""
WITH s AS (SELECT l_returnflag, covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_discount, l_discount) AS b, covar_pop(l_quantity, l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS d, covar_pop(l_discount, l_extendedprice) AS e FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((d * b - e * c) / (a * b - c * c), 4) AS slope_1, round((e * a - d * c) / (a * b - c * c), 4) AS slope_2 FROM s
""")
def two_regressor_slopes(t: Tables) -> DataFrame:
    return _rounded(aggregates.two_regressor_slopes(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity", "l_discount"), 4)


@query("SELECT l_orderkey, round(m + ln(sum(exp(l_quantity / 10 - m))), 9) AS log_sum FROM (SELECT *, max(l_quantity / 10) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1, m")
def log_sum_exp(t: Tables) -> DataFrame:
    return _rounded(aggregates.log_sum_exp(t.lineitem.withColumn("x", F.col("l_quantity") / 10), ["l_orderkey"], "x"), 9)


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, coalesce(x, avg(x) OVER (PARTITION BY l_orderkey), 0) AS x FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_quantity / 10 END AS x FROM lineitem)),
e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY l_orderkey)) AS e FROM f) SELECT l_orderkey, l_linenumber, round(e / sum(e) OVER (PARTITION BY l_orderkey), 9) AS share FROM e
""")
def softmax_share(t: Tables) -> DataFrame:
    x = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 10).alias("x"))
    return aggregates.softmax_share(x, ["l_orderkey"], "x").select("l_orderkey", "l_linenumber", F.round("share", 9).alias("share"))


@query("SELECT l_orderkey, round(sqrt(sum(power(l_tax * coalesce(nullif(l_discount, 0), 0), 2))), 9) AS sd, bool_and(nullif(l_discount, 0) IS NOT NULL) AS measured FROM lineitem GROUP BY 1")
def delta_method_sd(t: Tables) -> DataFrame:
    return _rounded(aggregates.delta_sd(t.lineitem.withColumn("sd0", F.nullif(F.col("l_discount"), F.lit(0.0))), ["l_orderkey"], "l_tax", "sd0"), 9)


_RUBIN = """
WITH r AS (SELECT l_suppkey, l_linenumber, avg(l_quantity) AS m, coalesce(var_samp(l_quantity), 0) AS v FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_suppkey, count(*) AS rounds, avg(m) AS mean, avg(v) AS within, coalesce(var_samp(m), 0) AS between FROM r GROUP BY 1),
q AS (SELECT *, within + (1 + 1.0 / rounds) * between AS total FROM p)
"""


@query(_RUBIN + 'SELECT l_suppkey, rounds, round(mean, 6) AS mean, round(within, 6) AS within, round(between, 6) AS "between", round(total, 6) AS total, round(sqrt(total), 6) AS sd, round(coalesce((1 + 1.0 / rounds) * between / nullif(total, 0), 0), 6) AS fmi FROM q'.replace('between /', '"between" /').replace("* between", '* "between"').replace("round(between", 'round("between"'))
def rubin_pool(t: Tables) -> DataFrame:
    return _rounded(aggregates.rubin(t.lineitem, "l_suppkey", "l_linenumber", "l_quantity"))


@query(_RUBIN + """, x AS (SELECT l_suppkey, avg(l_quantity) AS m, var_samp(l_quantity) AS v, quantile_cont(l_quantity, 0.025) AS lo, quantile_cont(l_quantity, 0.975) AS hi FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(m + (lo - m) * CASE WHEN v > 0 THEN sqrt(total / v) ELSE 1 END, 6) AS low, round(m + (hi - m) * CASE WHEN v > 0 THEN sqrt(total / v) ELSE 1 END, 6) AS high FROM x JOIN q USING (l_suppkey)""")
def widened_interval(t: Tables) -> DataFrame:
    pooled = aggregates.rubin(t.lineitem, "l_suppkey", "l_linenumber", "l_quantity")
    return _rounded(aggregates.widened_interval(t.lineitem, pooled, "l_suppkey", "l_quantity"))


@query("SELECT o_orderpriority, max(o_totalprice) AS rhat, min(o_totalprice) AS ess, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS divergences FROM orders GROUP BY 1")
def worst_case_roll_up(t: Tables) -> DataFrame:
    parts = t.orders.select("o_orderpriority", F.col("o_totalprice").alias("rhat"), F.col("o_totalprice").alias("ess"), (F.col("o_orderstatus") == "P").cast("int").alias("divergences"))
    return aggregates.worst_case(parts, ["o_orderpriority"], ["rhat"], ["ess"], ["divergences"])


_SCORED = "SELECT quality AS y, least(greatest(n_chars / 6000.0, 0.02), 0.98) AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL"


def _scored(t: Tables) -> DataFrame:
    j = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").filter("quality is not null")
    return j.select(F.col("quality").alias("y"), F.least(F.greatest(F.col("n_chars") / 6000.0, F.lit(0.02)), F.lit(0.98)).alias("p"))


@query(f"""
WITH d AS ({_SCORED}), b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(y AS DOUBLE)), 6) AS observed FROM d GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, observed FROM range(10) LEFT JOIN b ON bin = range
""")
def calibration_bins(t: Tables) -> DataFrame:
    return _rounded(aggregates.calibration(_scored(t), "p", "y", 10))


@query(f"WITH d AS ({_SCORED}) SELECT count(*) AS n, round(avg(CASE WHEN p = 0.5 THEN 0.5 WHEN (p > 0.5) = (y = 1) THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(power(p - y, 2)), 6) AS brier, round(avg(CAST(y AS DOUBLE)), 6) AS rate FROM d")
def binary_scores(t: Tables) -> DataFrame:
    return _rounded(aggregates.binary_scores(_scored(t), "p", "y"))


@query(f"WITH d AS (SELECT greatest(p, 1 - p) AS p, CASE WHEN p >= 0.5 THEN y ELSE 1 - y END AS y FROM ({_SCORED})) SELECT CAST(least(floor((p - 0.5) * 10), 4) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(y AS DOUBLE)), 6) AS observed FROM d GROUP BY 1")
def favourite_calibration(t: Tables) -> DataFrame:
    d = _scored(t).select(F.greatest("p", 1 - F.col("p")).alias("p"), F.when(F.col("p") >= 0.5, F.col("y")).otherwise(1 - F.col("y")).alias("y"))
    return d.groupBy(F.least(F.floor((F.col("p") - 0.5) * 10), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.col("y").cast("double")), 6).alias("observed"))


@query("""
WITH s AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY 1), p AS (SELECT *, CAST(k AS DOUBLE) / n AS p, 1.959963984540054 AS z FROM s)
SELECT l_suppkey, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 9) AS high FROM p
""")
def wilson_intervals(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    ci = wilson(F.col("k"), F.col("n"))
    return s.select("l_suppkey", F.round(ci["low"], 9).alias("low"), F.round(ci["high"], 9).alias("high"))


@query("""
WITH v AS (SELECT l_returnflag, l_extendedprice AS v, count(*) FILTER (l_linestatus = 'O') AS a, count(*) FILTER (l_linestatus <> 'O') AS b FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY l_returnflag) AS na, sum(b) OVER (PARTITION BY l_returnflag) AS nb FROM v WINDOW w AS (PARTITION BY l_returnflag ORDER BY v))
SELECT l_returnflag, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b, round(max(abs(ca / nullif(na, 0) - cb / nullif(nb, 0))), 9) AS distance FROM c GROUP BY 1
""")
def ks_distance(t: Tables) -> DataFrame:
    return _rounded(aggregates.ks_distance(t.lineitem, ["l_returnflag"], "l_extendedprice", F.col("l_linestatus") == "O"), 9)


@query("""
WITH s AS (SELECT s_suppkey, s_acctbal AS x, sum(l_quantity) AS y FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM s) SELECT 'all' AS part, count(*) AS n, round(corr(rx, ry), 9) AS rho FROM r
""")
def spearman(t: Tables) -> DataFrame:
    s = t.supplier.join(t.lineitem, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_suppkey", F.col("s_acctbal").alias("x")).agg(F.sum("l_quantity").alias("y"))
    return _rounded(windows.spearman(s.withColumn("part", F.lit("all")), ["part"], "x", "y"), 9)


@query("""
WITH d AS (SELECT lang, source, text, n_chars, CASE source WHEN 'src0' THEN 40 WHEN 'src1' THEN 35 WHEN 'src2' THEN 30 ELSE 10 END AS priority, doc_id FROM documents)
SELECT lang, (SELECT e.source FROM d e WHERE e.lang = d.lang ORDER BY priority DESC, doc_id LIMIT 1) AS source, CAST(count(DISTINCT source) - 1 AS BIGINT) AS source_dissent,
(SELECT e.n_chars FROM d e WHERE e.lang = d.lang AND e.n_chars IS NOT NULL ORDER BY priority DESC, doc_id LIMIT 1) AS n_chars, CAST(count(DISTINCT n_chars) - 1 AS BIGINT) AS n_chars_dissent FROM d GROUP BY lang
""")
def priority_merge(t: Tables) -> DataFrame:
    p = F.when(F.col("source") == "src0", 40).when(F.col("source") == "src1", 35).when(F.col("source") == "src2", 30).otherwise(10)
    return aggregates.priority_merge(t.documents.select("doc_id", "lang", "source", "n_chars"), "lang", p, "doc_id", ["source", "n_chars"])


@query("SELECT user_id, event_type, count(*) AS mentions, min_by(value, struct_pack(a := ts, b := event_id)) FILTER (value IS NOT NULL) AS value, min_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY 1, 2")
def commander_collapse(t: Tables) -> DataFrame:
    return aggregates.collapsed(t.events.select("user_id", "event_type", "ts", F.col("event_id"), "value"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "event_id"])


@query("SELECT round(CASE WHEN a >= 2 AND b >= 2 THEN ma - mb ELSE 0 END, 6) AS mean, round(CASE WHEN a >= 2 AND b >= 2 THEN greatest(2 * sqrt(va / a + vb / b), 0.3) ELSE 0.5 END, 6) AS sd FROM (SELECT count(*) FILTER (o_orderdate < TIMESTAMP '1995-01-01') AS a, count(*) FILTER (o_orderdate >= TIMESTAMP '1995-01-01') AS b, avg(ln(o_totalprice)) FILTER (o_orderdate < TIMESTAMP '1995-01-01') AS ma, avg(ln(o_totalprice)) FILTER (o_orderdate >= TIMESTAMP '1995-01-01') AS mb, var_samp(ln(o_totalprice)) FILTER (o_orderdate < TIMESTAMP '1995-01-01') AS va, var_samp(ln(o_totalprice)) FILTER (o_orderdate >= TIMESTAMP '1995-01-01') AS vb FROM orders)")
def era_effect(t: Tables) -> DataFrame:
    return _rounded(aggregates.era_effect(t.orders.withColumn("x", F.log("o_totalprice")), "x", F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")))


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in TABLES))
def table_counts(t: Tables) -> DataFrame:
    out = None
    for n in TABLES:
        one = getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out
