"""Queries of date texts, names, titles and contexts of figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.catalog import Tables
from talweg.functions import dates, labels, maths
from talweg.plans.registry import query


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 9 AS k FROM orders)
SELECT o_orderkey,
  CASE k WHEN 3 THEN strftime(d, '%Y-01-01 BC') WHEN 4 THEN strftime(d, '%Y-01-01') WHEN 5 THEN substr(strftime(d, '%Y'), 1, 3) || '0-01-01' WHEN 2 THEN strftime(d, '%Y-%m-01') WHEN 7 THEN strftime(d, '%Y-01-01') WHEN 8 THEN NULL
    ELSE strftime(d, '%Y-%m-%d') END AS date_start,
  CASE k WHEN 6 THEN strftime(last_day(d), '%Y-%m-%d') END AS date_end,
  CASE k WHEN 3 THEN 'year' WHEN 4 THEN 'year' WHEN 5 THEN 'decade' WHEN 2 THEN 'month' WHEN 7 THEN 'year' WHEN 8 THEN NULL ELSE 'day' END AS precision,
  CASE k WHEN 4 THEN true WHEN 5 THEN true WHEN 8 THEN NULL ELSE false END AS circa
FROM o
""")
def date_texts(t: Tables) -> DataFrame:
    """Order dates written in nine ways and read again."""
    d = F.to_date("o_orderdate")
    year, long, short = F.date_format(d, "yyyy"), F.date_format(d, "d MMMM yyyy"), F.date_format(d, "MMM. d, yyyy")
    span = F.concat(F.date_format(d, "MMMM d"), F.lit("–"), F.day(F.last_day(d)).cast("string"), F.lit(", "), year)
    ways = [long, short, F.date_format(d, "MMMM yyyy"), F.concat(year, F.lit(" BC")), F.concat(F.lit("c. "), year), F.concat(F.lit("late "), F.substring(year, 1, 3), F.lit("0s")), span, F.concat(F.lit("Spring "), year), F.concat(F.lit("perhaps "), long)]
    read = dates.parse_date(F.get(F.array(*ways), (F.col("o_orderkey") % 9).cast("int")))
    return t.orders.select("o_orderkey", read.alias("d")).select("o_orderkey", "d.date_start", "d.date_end", "d.precision", "d.circa")


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 3 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS date_start, CASE k WHEN 1 THEN strftime(d + 3, '%Y-%m-%d') END AS date_end, CASE k WHEN 0 THEN 'year' WHEN 3 THEN NULL ELSE 'day' END AS precision,
  CAST(day(last_day(d)) AS INTEGER) AS month_days, CASE WHEN o_orderkey % 5000 <= 3000 THEN printf('%04d-01-01', 3001 - o_orderkey % 5000) ELSE printf('%04d-01-01 BC', o_orderkey % 5000 - 3000) END AS year_date FROM o
""")
def stored_dates(t: Tables) -> DataFrame:
    d, k = F.to_date("o_orderdate"), (F.col("o_orderkey") % 4).cast("int")
    start = F.get(F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "d MMM yyyy"), F.date_format(d, "d MMM yyyy"), F.lit("one day")), k)
    end = F.when(k == 1, F.date_format(F.date_add(d, 3), "d MMMM yyyy"))
    safe = dates.safe_dates(start, end, F.when(k == 0, "year").otherwise("century"))
    days = dates.days_in_month(F.year(d), F.month(d), F.lit(False))
    literal = dates.year_literal((3001 - F.col("o_orderkey") % 5000).cast("int"))
    return t.orders.select("o_orderkey", safe.alias("s"), days.alias("month_days"), literal.alias("year_date")).select("o_orderkey", "s.date_start", "s.date_end", "s.precision", "month_days", "year_date")


@query("""
WITH p AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')) AS name, p_partkey % 4 AS k FROM part), n AS (SELECT p_partkey, trim(name) AS name, k FROM p)
SELECT p_partkey, CASE k WHEN 3 THEN 'siege of' ELSE name END AS core, CASE k WHEN 1 THEN 'second' WHEN 2 THEN '3rd' END AS number, CASE k WHEN 0 THEN 'battle' WHEN 1 THEN 'unknown' ELSE 'Q' || p_partkey END AS polity, k IN (0, 3) AS engagement
FROM n
""")
def engagement_names(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    plain = F.trim(F.regexp_replace("p_name", r"[^A-Za-z0-9]+", " "))
    name = F.when(k == 0, F.concat(F.lit("Battle of the "), plain)).when(k == 1, F.concat(F.lit("Raid on "), plain)).when(k == 2, F.concat(F.lit("Capture of "), plain)).otherwise("Siege of")
    numbered = F.when(k == 1, F.concat(F.lit("Second "), name)).when(k == 2, F.concat(F.lit("The 3rd "), name)).otherwise(name)
    title = F.when(k == 0, numbered).when(k == 1, F.concat(F.lit("List of "), name)).when(k == 2, F.concat(F.lit("File: "), name)).otherwise("Siege of X")
    polity = labels.polity_key(F.when(k > 1, F.concat(F.lit(" Q"), F.col("p_partkey"), F.lit(" "))), F.when(k == 0, " battle ").otherwise(" "))
    return t.part.select("p_partkey", labels.core_name(name).alias("core"), labels.ordinal(numbered).alias("number"), polity.alias("polity"), labels.is_engagement_title(title).alias("engagement"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, l_linenumber % 4 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, k IN (0, 3) AND NOT (k = 3 AND q % 2 = 0) AS things, k = 2 AND q < 60 AS bracketed, k = 1 AS total, CASE WHEN k = 1 THEN NULL WHEN k = 0 AND q BETWEEN 1 AND 28 THEN 2 END AS date_numbers FROM l
""")
def figure_contexts(t: Tables) -> DataFrame:
    q, k = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 4
    text = q.cast("string")
    last = F.when(q % 2 == 0, " men on ships").otherwise(" large war galleys")
    context = F.when(k == 0, F.concat(text, F.lit("-"), text, F.lit(" guns"))).when(k == 1, F.concat(F.lit("Total: 9,000 men "), text)).when(k == 2, F.concat(F.lit("1,060 men ("), text, F.lit(" crossed)"))).otherwise(F.concat(text, last))
    label = F.when(k == 0, F.when(q <= 28, F.concat(F.lit("On "), text, F.lit(" March 1944 :"))).otherwise("no date")).otherwise("12 men")
    value = q.cast("double")
    return t.lineitem.select("l_orderkey", "l_linenumber", labels.counts_things(value, context).alias("things"), labels.is_bracketed_part(value, context).alias("bracketed"), labels.is_stated_total(context).alias("total"), F.size(labels.date_label_numbers(label)).alias("date_numbers"))


@query(r"""
WITH c AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN source END AS extra FROM documents)
SELECT doc_id, lang || '|x y' || CASE WHEN extra IS NOT NULL AND extra <> lang THEN '|' || extra ELSE '' END AS categories FROM c
""")
def page_categories(t: Tables) -> DataFrame:
    extra = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(' href="/wiki/Category:'), F.col("source"), F.lit('#top"'))).otherwise("")
    text = F.concat(F.lit("a [[Category: "), F.col("lang"), F.lit('|key]] b [[category:x y ]] href="/wiki/Category:x_y"'), extra)
    return t.documents.select("doc_id", F.array_join(labels.categories(text), "|").alias("categories"))


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity - l_tax + 0.5 * l_discount - 2.0 * l_linenumber, 9) AS eta, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'O' THEN 0 ELSE 0 END AS flag_a,
CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END WHEN l_returnflag = 'R' THEN 1 WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS flag_b,
CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'O' THEN 'none' ELSE 'filled' END WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'O' THEN 'both' ELSE 'filled' END ELSE CASE WHEN l_linestatus = 'O' THEN 'filled' ELSE 'none' END END AS status,
CASE WHEN l_linenumber % 3 = 0 THEN l_quantity - 1 WHEN l_linenumber % 3 = 1 THEN round(l_quantity - 1.959963985 * l_tax, 6) END AS low, CAST(ceil(12 * l_linenumber / 20.0) AS BIGINT) AS least,
round((greatest(l_orderkey - l_partkey, 0) * 3.0 + l_partkey * 3.0 * 0.1 + l_suppkey * 3.0 * 1.25 + l_linenumber * 15.0) / 1e6, 9) AS cost FROM lineitem
""")
def model_arithmetic(t: Tables) -> DataFrame:
    c = F.col
    a = F.when(c("l_returnflag") == "A", True).when(c("l_returnflag") == "R", False)
    flags = maths.paired_flags(a, F.when(c("l_linestatus") == "O", True))
    third = c("l_linenumber") % 3
    interval = maths.stored_or_normal(F.when(third == 0, c("l_quantity") - 1), F.when(third == 0, c("l_quantity")), F.when(third < 2, c("l_quantity")), c("l_tax"), round(maths.z_for_level(0.95), 9))
    eta = maths.linear_predictor(c("l_quantity"), c("l_tax"), c("l_discount"), c("l_linenumber"), 0.5, -2.0)
    cost = maths.call_cost(c("l_orderkey"), c("l_linenumber"), c("l_partkey"), c("l_suppkey"), F.lit(3.0), F.lit(15.0), F.lit(0.1), F.lit(1.25))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(eta, 9).alias("eta"), flags["a"].alias("flag_a"), flags["b"].alias("flag_b"), flags["status"].alias("status"),
        F.round(interval["low"], 6).alias("low"), maths.scaled_minimum(c("l_linenumber")).alias("least"), F.round(cost, 9).alias("cost"),
    )


@query("""
WITH y AS (SELECT o_orderkey, lower(o_orderpriority) AS p, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)
SELECT o_orderkey, CASE WHEN p IN ('1-urgent', '2-high') AND y BETWEEN 1992 AND 1994 THEN 'early' WHEN p = '5-low' AND y BETWEEN 1990 AND 1999 THEN 'low' END AS reason FROM y
""")
def regime_rules(t: Tables) -> DataFrame:
    rules = (("1-urgent|2-high", 1992, 1994, "early"), ("5-low", 1990, 1999, "low"))
    return t.orders.select("o_orderkey", labels.first_match(F.col("o_orderpriority"), F.year("o_orderdate"), rules).alias("reason"))
