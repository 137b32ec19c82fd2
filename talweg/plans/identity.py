"""Queries of names and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.catalog import Tables
from talweg.functions import text
from talweg.functions.maths import command_window
from talweg.operators import identity
from talweg.plans.registry import query


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS folded, replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ', '') AS squashed FROM part")
def fold_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.fold_name(F.col("p_name")).alias("folded"), text.squashed(F.col("p_name")).alias("squashed"))


@query("SELECT s_suppkey, split_part(s_name, '#', 1) AS first_token, split_part(s_name, '#', -1) AS last_token, length(s_name) AS n FROM supplier")
def first_last_token(t: Tables) -> DataFrame:
    spaced = F.replace(F.col("s_name"), F.lit("#"), F.lit(" "))
    return t.supplier.select("s_suppkey", text.first_token(spaced).alias("first_token"), text.last_token(spaced).alias("last_token"), F.length("s_name").cast("long").alias("n"))


@query("""
WITH n AS (SELECT p_partkey, p_brand, p_size, p_name FROM part), s AS (SELECT a.p_partkey AS a, b.p_partkey AS b, 100.0 * (greatest(length(a.p_name), length(b.p_name)) - levenshtein(a.p_name, b.p_name)) / greatest(length(a.p_name), length(b.p_name)) AS score
FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey) SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 60
""")
def similar_name_pairs(t: Tables) -> DataFrame:
    return identity.similar_pairs(t.part, "p_partkey", "p_name", ["p_brand", "p_size"], 60).withColumn("score", F.round("score", 6))


@query("""
WITH y AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN CAST(1700 + c_custkey % 100 AS INTEGER) END AS birth, CASE WHEN c_custkey % 4 > 0 THEN CAST(1760 + c_custkey % 90 AS INTEGER) END AS death, CAST(c_custkey % 5 AS INTEGER) AS s FROM customer)
SELECT c_custkey, CASE WHEN birth IS NOT NULL THEN birth - s + 15 ELSE death - s - 100 END - 2 AS low, CASE WHEN death IS NOT NULL THEN death + s ELSE birth + s + 100 END + 2 AS high FROM y
""")
def command_windows(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    birth, death, slack = F.when(k % 3 > 0, (1700 + k % 100).cast("int")), F.when(k % 4 > 0, (1760 + k % 90).cast("int")), (k % 5).cast("int")
    w = command_window(birth, slack, death, slack)
    return t.customer.select("c_custkey", w["low"].alias("low"), w["high"].alias("high"))


@query("""
WITH p AS (SELECT o_custkey AS grp, o_orderkey AS cand, o_orderpriority = '1-URGENT' AS exact, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN NULL ELSE false END AS dated, 60 + CAST(floor(o_totalprice) AS BIGINT) % 40 AS score, CASE WHEN o_orderpriority = '2-HIGH' THEN 3 ELSE 0 END AS bonus FROM orders),
l AS (SELECT * FROM p WHERE coalesce(dated, true)), f AS (SELECT grp, count(*) FILTER (exact) AS ne, min(cand) FILTER (exact) AS eid, count(*) FILTER (exact AND coalesce(dated, false)) AS ns, min(cand) FILTER (exact AND coalesce(dated, false)) AS sid FROM l GROUP BY 1),
b AS (SELECT * FROM (SELECT grp, cand, score, score - lead(score) OVER w AS margin, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY grp ORDER BY score + bonus DESC, score DESC, cand)) WHERE n = 1),
j AS (SELECT g.grp, ne, eid, ns, sid, b.cand, b.score, margin, (ne = 1 OR (ne > 1 AND ns = 1)) AS one, coalesce(margin >= 6, true) AS apart FROM (SELECT DISTINCT grp FROM p) g LEFT JOIN f ON f.grp = g.grp LEFT JOIN b ON b.grp = g.grp),
v AS (SELECT *, CASE WHEN cand IS NULL THEN 'new' WHEN one THEN 'linked' WHEN ne > 1 THEN 'ambiguous' WHEN score >= 85 AND apart THEN 'linked' WHEN score >= 70 THEN 'ambiguous' ELSE 'new' END AS verdict FROM j)
SELECT grp, verdict, CASE WHEN one THEN CASE WHEN ne = 1 THEN eid ELSE sid END WHEN ne = 0 AND score >= 85 AND apart THEN cand END AS cand, CASE WHEN one THEN 0.95 WHEN verdict = 'linked' THEN round(0.5 + 0.42 * (score - 85) / 15, 3) WHEN verdict = 'new' THEN 0.6 END AS confidence FROM v
""")
def match_decisions(t: Tables) -> DataFrame:
    o = t.orders
    pairs = o.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("cand"), (F.col("o_orderpriority") == "1-URGENT").alias("exact"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False).alias("dated"), (60 + F.floor("o_totalprice") % 40).alias("score"), F.when(F.col("o_orderpriority") == "2-HIGH", 3).otherwise(0).alias("bonus"))
    return identity.decisions(pairs, "grp", "cand", F.col("exact"), F.col("dated"), F.col("score"), F.col("bonus"))


@query("""
WITH RECURSIVE m AS (SELECT o_orderkey AS id, unnest(['c' || (o_custkey % 400), 'd' || CAST(floor(o_totalprice * 100) AS BIGINT) % 100000]) AS k FROM orders),
r(node, least) USING KEY (node) AS (
  SELECT DISTINCT id, id FROM m UNION
  SELECT m.id, min(l.least) FROM (SELECT m.k, min(q.least) AS least FROM recurring.r q JOIN m ON m.id = q.node GROUP BY 1) l JOIN m ON m.k = l.k JOIN recurring.r o ON o.node = m.id WHERE l.least < o.least GROUP BY 1)
SELECT node AS o_orderkey, least AS "group" FROM r
""")
def mention_groups(t: Tables) -> DataFrame:
    keys = F.array(F.concat(F.lit("c"), F.col("o_custkey") % 400), F.concat(F.lit("d"), F.floor(F.col("o_totalprice") * 100) % 100000))
    return identity.key_groups(t.orders.select("o_orderkey", keys.alias("keys")), "o_orderkey", "keys")


@query("""
WITH n AS (SELECT l_suppkey, l_shipmode, count(*) AS n, max(l_shipmode <> 'R') AS f FROM (SELECT l_suppkey, l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1, 2)
SELECT l_suppkey, max_by(l_shipmode, struct_pack(f := f, n := n, l := length(l_shipmode), t := l_shipmode)) AS form FROM n GROUP BY 1
""")
def display_names(t: Tables) -> DataFrame:
    return identity.display_name(t.lineitem.select("l_suppkey", F.col("l_returnflag").alias("form")), "l_suppkey", "form", F.col("form") != "R")


@query("""
WITH l AS (SELECT o_custkey, o_orderkey, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS d FROM orders), s AS (SELECT *, CASE WHEN d - lag(d) OVER w > 120 THEN 1 ELSE 0 END AS step FROM l WINDOW w AS (PARTITION BY o_custkey ORDER BY d, o_orderkey))
SELECT o_orderkey, CAST(sum(step) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s
""")
def career_split(t: Tables) -> DataFrame:
    days = t.orders.select("o_custkey", "o_orderkey", F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("d"))
    return identity.career_sessions(days, "o_custkey", "d", "o_orderkey", 120).select("o_orderkey", "session")
