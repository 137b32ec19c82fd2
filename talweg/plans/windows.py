"""Queries of window operators, orders and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.catalog import Tables
from talweg.operators import windows
from talweg.plans.registry import query


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER w, 4) AS total, round(l_quantity / nullif(sum(l_quantity) OVER w, 0), 9) AS share FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def share_of_partition(t: Tables) -> DataFrame:
    return windows.with_share(t.lineitem, ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", F.round("total", 4).alias("total"), F.round("share", 9).alias("share"))


@query("SELECT event_type, event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def latest_per_type(t: Tables) -> DataFrame:
    return windows.first_per_key(t.events, ["event_type"], F.desc("ts"), F.asc("event_id")).select("event_type", "event_id", "user_id", "value")


@query("SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY nullif(l_discount, 0) DESC NULLS LAST, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def heaviest_row_nulls_last(t: Tables) -> DataFrame:
    return windows.first_per_key(t.lineitem, ["l_orderkey", "l_suppkey"], F.desc_nulls_last(F.nullif(F.col("l_discount"), F.lit(0.0))), F.asc("l_linenumber")).select("l_orderkey", "l_suppkey", "l_linenumber")


@query("SELECT l_orderkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY v DESC, l_suppkey) AS n FROM (SELECT l_orderkey, l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)) WHERE n = 1")
def primary_actor(t: Tables) -> DataFrame:
    return windows.primary_member(t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_extendedprice").alias("v")), ["l_orderkey"], "l_suppkey", "v")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def rank_descending(t: Tables) -> DataFrame:
    return windows.ranked_descending(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", "rank")


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank FROM part")
def average_ranks(t: Tables) -> DataFrame:
    return windows.average_ranks(t.part, ["p_brand"], "p_size", "rank").select("p_partkey", "rank")


_SUPPLIERS = "SELECT l_suppkey, avg(l_quantity) AS m, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1"


@query(f"""
WITH s AS ({_SUPPLIERS}), i AS (SELECT l_suppkey, l_suppkey % 7 AS grp, row_number() OVER (PARTITION BY l_suppkey % 7 ORDER BY m DESC, l_suppkey) AS place, m - 1.96 * se AS low, m + 1.96 * se AS high FROM s),
n AS (SELECT *, lead(low) OVER w AS lo2, lead(high) OVER w AS hi2 FROM i WINDOW w AS (PARTITION BY grp ORDER BY place))
SELECT l_suppkey, place, CASE WHEN lo2 IS NOT NULL THEN CASE WHEN least(high - low, hi2 - lo2) > 0 THEN greatest(least(high, hi2) - greatest(low, lo2), 0) / least(high - low, hi2 - lo2) > 0.5 ELSE least(high, hi2) >= greatest(low, lo2) END END AS overlaps_next FROM n
""")
def rank_overlap_next(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m"), (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("se"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("grp").orderBy(F.desc("m"), "l_suppkey")
    i = s.withColumn("grp", F.col("l_suppkey") % 7).withColumn("place", F.row_number().over(w)).withColumn("low", F.col("m") - 1.96 * F.col("se")).withColumn("high", F.col("m") + 1.96 * F.col("se"))
    return windows.overlap_with_next(i, ["grp"], "place", "low", "high", 0.5).select("l_suppkey", "place", "overlaps_next")


@query("""
WITH l AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w > 21600 THEN 1 ELSE 0 END AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM l
""")
def gap_sessions(t: Tables) -> DataFrame:
    seconds = t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return windows.sessions(seconds, ["user_id"], "at", 21600, "event_id").select("event_id", "session")


@query("WITH d AS (SELECT DISTINCT CAST(floor(o_totalprice / 1000) AS BIGINT) AS b FROM orders), n AS (SELECT b, lead(b) OVER (ORDER BY b) AS c FROM d) SELECT b AS after, c AS before FROM n WHERE c - b > 1")
def empty_spans(t: Tables) -> DataFrame:
    return windows.gaps(t.orders.withColumn("b", F.floor(F.col("o_totalprice") / 1000)), "b", 1)


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS score, o_totalprice AS raw FROM orders), r AS (SELECT *, row_number() OVER w AS n, lead(raw) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY score DESC, raw DESC, o_orderkey))
SELECT o_custkey, o_orderkey, round(raw - nxt, 2) AS margin FROM r WHERE n = 1
""")
def top_two_margin(t: Tables) -> DataFrame:
    c = t.orders.withColumn("score", F.floor(F.col("o_totalprice") / 1000)).withColumn("raw", F.col("o_totalprice"))
    return windows.top_two_margin(c, ["o_custkey"], "o_orderkey", "score", "raw").select("o_custkey", "o_orderkey", F.round("margin", 2).alias("margin"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS good FROM lineitem) WHERE NOT good OR l_returnflag = 'R' OR l_tax = 0")
def supersede_by_flag(t: Tables) -> DataFrame:
    return windows.keep_unless_group(t.lineitem, ["l_orderkey"], F.col("l_returnflag") == "R", F.col("l_tax") == 0).select("l_orderkey", "l_linenumber")


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, l_returnflag AS kind, bool_or(l_returnflag = 'N') OVER (PARTITION BY l_orderkey) AS total, count(DISTINCT CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag END) OVER (PARTITION BY l_orderkey) AS kinds FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT total AND kinds = 1 AND kind IN ('A', 'R') THEN 'N' ELSE kind END AS kind, NOT total AND kinds = 1 AND kind IN ('A', 'R') AS promoted FROM w
""")
def lone_kind_promotion(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"))
    return windows.lone_kind(rows, ["l_orderkey"], "kind", "N", ["A", "R"]).select("l_orderkey", "l_linenumber", "kind", "promoted")


@query("SELECT l_orderkey, round(ln(max(l_extendedprice) / min(l_extendedprice)), 9) AS log_span, CASE WHEN ln(max(l_extendedprice) / min(l_extendedprice)) > 2 THEN 'error' ELSE 'warning' END AS severity FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1 HAVING ln(max(l_extendedprice) / min(l_extendedprice)) > 1")
def span_guard(t: Tables) -> DataFrame:
    return windows.span_guard(t.lineitem, ["l_orderkey"], "l_extendedprice").withColumn("log_span", F.round("log_span", 9))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS part FROM conversations")
def forward_fill_route(t: Tables) -> DataFrame:
    return windows.forward_filled(t.conversations, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "part").select("conv_id", "turn", "part")


@query("""
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, line ORDER BY doc_id, pos) AS n FROM l)
SELECT source, doc_id, CAST(pos AS INTEGER) AS pos FROM r WHERE n = 1
""")
def repeated_passage_drop(t: Tables) -> DataFrame:
    lines = t.documents.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("pos", F.col("p") + 1)
    # the digest stands for the line, so that long ones don't travel
    return windows.first_per_key(lines.select("source", "doc_id", "pos", F.sha2("line", 256).alias("h")), ["source", "h"], F.asc("doc_id"), F.asc("pos")).select("source", "doc_id", "pos")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
def top_by_score(t: Tables) -> DataFrame:
    return t.customer.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(25).select("c_custkey", "c_name")


@query("""
WITH n AS (SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_custkey, n, n >= 10 AS headline, CASE WHEN n >= 10 THEN row_number() OVER (PARTITION BY n >= 10 ORDER BY n DESC, c_name, c_custkey) END AS place FROM n
""")
def headline_and_thin(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    n = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("n"))
    place = F.row_number().over(Window.partitionBy("headline").orderBy(F.desc("n"), "c_name", "c_custkey"))
    return n.withColumn("headline", F.col("n") >= 10).select("c_custkey", "n", "headline", F.when(F.col("headline"), place).alias("place"))


@query("""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i FROM (SELECT o_orderkey, o_totalprice FROM orders)) SELECT o_orderkey FROM n WHERE i % CAST(ceil((SELECT count(*) FROM orders) / 500.0) AS BIGINT) = 0
""")
def stride_sample(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_totalprice")
    step = max(1, -(-o.count() // 500))
    return windows.ranked_descending(o, "o_totalprice", "o_orderkey").filter((F.col("rank") - 1) % step == 0).select("o_orderkey")


@query("""
WITH n AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem), g AS (SELECT range AS j FROM range(10))
SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM n LEFT JOIN g ON round(j * (n - 1) / 9.0) = i WHERE n <= 10 OR j IS NOT NULL
""")
def evenly_spaced_draws(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("at"))
    return windows.evenly_spaced(rows, ["l_suppkey"], "at", 10).drop("at")


@query()
def section_packing(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", F.length("text").alias("n"))
    return windows.packed(turns, ["conv_id"], "turn", "n", 600)


@query("SELECT l_orderkey, max(abs(total - 1)) AS off FROM (SELECT l_orderkey, round(sum(l_discount + l_tax), 6) AS total FROM lineitem GROUP BY 1) WHERE abs(total - 1) > 0.9 GROUP BY 1".replace("max(abs(total - 1))", "round(max(abs(total - 1)), 6)"))
def share_sum_deviation(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_discount") + F.col("l_tax")), 6).alias("total"))
    return s.filter(F.abs(F.col("total") - 1) > 0.9).select("l_orderkey", F.round(F.abs(F.col("total") - 1), 6).alias("off"))
