"""Queries of reports and inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.catalog import Tables
from talweg.operators import reports, windows
from talweg.plans.registry import query


@query("""
WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), s AS (SELECT min(rank) AS a, max(rank) AS b FROM r WHERE c_mktsegment = 'BUILDING' AND c_custkey % 5 = 0)
SELECT count(*) AS n FROM r, s WHERE c_mktsegment <> 'BUILDING' AND rank BETWEEN a AND b
""")
def ranks_in_gaps(t: Tables) -> DataFrame:
    ranked = windows.ranked_descending(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", "c_custkey")
    return reports.ranks_in_gaps(ranked.filter("c_mktsegment = 'BUILDING' and c_custkey % 5 = 0"), ranked.filter("c_mktsegment <> 'BUILDING'"), "rank")


@query("SELECT l_suppkey, count(DISTINCT l_linenumber) AS rounds, round(stddev_samp(ln(l_extendedprice)), 9) AS sd FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1 ORDER BY stddev_samp(ln(l_extendedprice)) DESC, l_suppkey LIMIT 30")
def round_spread(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_linenumber", F.log("l_extendedprice").alias("x"), (F.col("l_returnflag") == "R").alias("imputed"))
    return reports.round_spread(rows, "l_suppkey", "l_linenumber", "x", F.col("imputed"), 30).withColumn("sd", F.round("sd", 9))


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'imputed' ELSE 'observed' END AS kind, floor(l_quantity / 5) * 5 AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def observed_and_imputed(t: Tables) -> DataFrame:
    return reports.two_histograms(t.lineitem, "l_quantity", F.col("l_returnflag") == "R", 5.0).withColumn("bin", F.col("bin").cast("double"))


@query("SELECT o_orderkey, round(r, 6) AS reported, o_totalprice AS estimate FROM orders LEFT JOIN (SELECT l_orderkey, avg(l_extendedprice) AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def reported_and_estimated(t: Tables) -> DataFrame:
    found = reports.reported_and_estimated(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), t.orders, "o_orderkey", "l_extendedprice", "o_totalprice")
    return found.withColumn("reported", F.round("reported", 6))


@query("""
WITH c AS (SELECT l_quantity * 2 AS s, CASE WHEN l_linenumber % 5 > 0 THEN l_discount * 100 END AS m, l_returnflag = 'R' AS t FROM lineitem),
g AS (SELECT * FROM (VALUES (70.0), (85.0), (95.0)) a(min_score), (VALUES (0.0), (3.0), (6.0)) b(min_margin)),
x AS (SELECT CAST(min_score AS DOUBLE) AS min_score, CAST(min_margin AS DOUBLE) AS min_margin, t, s >= min_score AND coalesce(m >= min_margin, true) AS linked FROM c, g)
SELECT min_score, min_margin, count(*) FILTER (linked) AS linked, count(*) FILTER (linked AND t) AS "right", count(*) FILTER (linked AND t) / nullif(count(*) FILTER (linked), 0) AS precision, count(*) FILTER (linked AND t) / nullif(count(*) FILTER (t), 0) AS recall FROM x GROUP BY 1, 2
""")
def threshold_sweep(t: Tables) -> DataFrame:
    cases = t.lineitem.select((F.col("l_quantity") * 2).alias("score"), F.when(F.col("l_linenumber") % 5 > 0, F.col("l_discount") * 100).alias("margin"), (F.col("l_returnflag") == "R").alias("truth"))
    return reports.sweep(cases, "score", "margin", F.col("truth"), (70, 85, 95), (0, 3, 6))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, -l_quantity AS p, unnest([l_shipmode_, lower(l_shipmode_), l_flag]) AS tag, generate_subscripts([1, 2, 3], 1) AS i FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_, l_returnflag AS l_flag FROM lineitem)),
f AS (SELECT l_orderkey, lower(tag) AS low, min(struct_pack(p := p, t := l_linenumber, i := i, tag := tag)) AS x FROM r GROUP BY 1, 2)
SELECT l_orderkey, string_agg(x.tag, ',' ORDER BY x) AS tags FROM f GROUP BY 1
""")
def merged_tags(t: Tables) -> DataFrame:
    both = F.concat("l_returnflag", "l_linestatus")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.array(both, F.lower(both), F.col("l_returnflag")).alias("tags"))
    return reports.merged_tags(rows, "l_orderkey", F.col("l_quantity"), "l_linenumber", "tags").withColumn("tags", F.array_join("tags", ","))


@query("SELECT event_id, event_type || CASE WHEN value > 50 THEN ',high' ELSE '' END AS notes FROM events")
def merged_notes(t: Tables) -> DataFrame:
    notes = reports.merged_notes(F.array(F.col("event_type"), F.lit(" ")), F.lit(None).cast("array<string>"), F.array(F.col("event_type"), F.when(F.col("value") > 50, "high").otherwise("")))
    return t.events.select("event_id", F.array_join(notes, ",").alias("notes"))


@query("""
WITH c AS (SELECT user_id, event_type AS f, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, length(f) DESC, f) AS k FROM c)
SELECT user_id, string_agg(f, ',' ORDER BY k) AS names FROM r WHERE k <= 2 GROUP BY 1
""")
def query_names(t: Tables) -> DataFrame:
    return reports.query_names(t.events, "user_id", "event_type", 2).withColumn("names", F.array_join("names", ","))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, max(l_discount > 0.08) OVER (PARTITION BY l_orderkey) AS anyone FROM lineitem) WHERE l_discount > 0.08 OR NOT anyone")
def superseded_rows(t: Tables) -> DataFrame:
    return reports.superseded(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount"), ["l_orderkey"], F.col("l_discount") > 0.08).select("l_orderkey", "l_linenumber")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN 'indecisive' WHEN 1 THEN 'decisive_victory' WHEN 2 THEN 'minor_victory' END AS level, l_quantity > 40 AS w, CASE WHEN l_linenumber = 1 THEN 'given' END AS had FROM lineitem),
n AS (SELECT *, sum(CAST(w AS INTEGER)) OVER (PARTITION BY l_orderkey) AS n FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN level = 'indecisive' THEN coalesce(had, 'indecisive') WHEN level IS NOT NULL AND n = 1 THEN CASE WHEN w THEN level WHEN level = 'decisive_victory' THEN 'decisive_defeat' ELSE 'minor_defeat' END ELSE had END AS outcome FROM n
""")
def side_outcomes(t: Tables) -> DataFrame:
    k = F.col("l_orderkey") % 4
    level = F.when(k == 0, "indecisive").when(k == 1, "decisive_victory").when(k == 2, "minor_victory")
    sides = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", level.alias("level"), F.when(F.col("l_linenumber") == 1, "given").alias("had"))
    mirror = {"decisive_victory": "decisive_defeat", "minor_victory": "minor_defeat"}
    return reports.outcomes(sides, "l_orderkey", F.col("l_quantity") > 40, "level", mirror, "had").select("l_orderkey", "l_linenumber", "outcome")


@query("""
WITH d AS (SELECT event_id, CASE WHEN value > 20 THEN value END AS value, CASE WHEN event_id % 3 > 0 THEN event_type ELSE ' ' END AS kind FROM events)
SELECT event_id, 'value' AS field, 'no value' AS note FROM d WHERE value IS NULL UNION ALL SELECT event_id, 'kind', 'no kind' FROM d WHERE trim(kind) = ''
""")
def missing_fields(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("value") > 20, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise(" ").alias("kind"))
    return reports.missing_fields(rows, ["event_id"], {"value": "no value", "kind": "no kind"})


@query("""
WITH d AS (SELECT DISTINCT user_id, trim(event_type) AS x FROM events)
SELECT user_id, count(*) FILTER (regexp_matches(x, 'c')) AS hits, count(*) AS "all", count(*) FILTER (regexp_matches(x, 'c')) > 0 AND 2 * count(*) FILTER (regexp_matches(x, 'c')) >= count(*) AS mostly FROM d GROUP BY 1
""")
def mostly_matching(t: Tables) -> DataFrame:
    return reports.mostly(t.events, "user_id", "event_type", "c")


@query("SELECT count(*) AS n, round(avg(CASE WHEN x = 0 THEN 0.5 WHEN (x > 0) = w THEN 1 ELSE 0 END), 9) AS accuracy FROM (SELECT l_quantity - 25 AS x, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS w FROM lineitem) WHERE w IS NOT NULL")
def larger_wins(t: Tables) -> DataFrame:
    won = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    return reports.larger_wins(t.lineitem, F.col("l_quantity") - 25, won).withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT CAST(year(l_shipdate) AS INTEGER) AS era, count(*) AS n, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean, sum(l_quantity) AS weight FROM lineitem GROUP BY 1")
def weighted_means(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.year("l_shipdate").alias("era"), "l_discount", "l_quantity")
    return reports.weighted_means(rows, ["era"], "l_discount", "l_quantity").withColumn("mean", F.round("mean", 9))


@query("SELECT event_id, value FROM events WHERE value < 5 OR event_type = 'purchase'")
def review_queue(t: Tables) -> DataFrame:
    role = F.when(F.col("event_type") == "purchase", "unknown").otherwise(F.col("event_type"))
    return reports.review_queue(t.events.withColumn("role", role), "value", "role", "event_id", 5).select("event_id", "value")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'unknown' WHEN 'A' THEN 'field' END AS v, CASE l_linenumber % 3 WHEN 0 THEN 'rules' WHEN 1 THEN 'manual' END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber FROM s WHERE (v IS NULL OR v = 'unknown' OR s IS NOT DISTINCT FROM 'rules') AND s IS DISTINCT FROM 'manual'
""")
def needs_value(t: Tables) -> DataFrame:
    k = F.col("l_linenumber") % 3
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "unknown").when(F.col("l_returnflag") == "A", "field").alias("v"), F.when(k == 0, "rules").when(k == 1, "manual").alias("s"))
    return reports.needs_value(rows, "v", "s", "rules").select("l_orderkey", "l_linenumber")


@query("""
WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'price' ELSE 'status' END AS field FROM orders), r AS (SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN o_totalprice END AS price, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders)
SELECT g.o_orderkey, field FROM g JOIN r USING (o_orderkey) WHERE (field = 'price' AND price IS NOT NULL) OR (field = 'status' AND status IS NOT NULL)
""")
def filled_gaps(t: Tables) -> DataFrame:
    gaps = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "price").otherwise("status").alias("field"))
    rows = t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 150000, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return reports.filled_gaps(gaps, rows, "o_orderkey", "field", ["price", "status"])


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN c_acctbal END AS c_acctbal, c_nationkey FROM customer")
def cleared_unfitted(t: Tables) -> DataFrame:
    fitted = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return reports.cleared(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), fitted, "c_custkey", ["c_acctbal"])


@query("SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS c_custkey FROM orders")
def retired_references(t: Tables) -> DataFrame:
    children = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return reports.retired(t.customer, children, t.customer.filter("c_acctbal < 0"), "c_custkey")[1]
