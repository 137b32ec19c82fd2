"""Queries of scalar functions: text, URLs, JSON, numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.catalog import Tables
from talweg.functions import maths, text
from talweg.plans.registry import query


@query("SELECT l_orderkey, l_linenumber, CASE WHEN length(s) > 1 THEN (length(s) - length(rtrim(s, '0'))) / (length(s) - 1) ELSE 0 END AS roundness FROM (SELECT *, CAST(CAST(round(l_quantity * 100) AS BIGINT) AS VARCHAR) AS s FROM lineitem)")
def roundness(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", maths.roundness(F.col("l_quantity") * 100).alias("roundness"))


_FIRST_NUMBER = r"(?i)(\d+(?:,\d{3})*(?:\.\d+)?)(?:\s*(hundred|thousand|million|billion)\b)?"


@query(f"""
WITH n AS (SELECT doc_id, regexp_extract(text, '{_FIRST_NUMBER}', 1) AS digits, lower(regexp_extract(text, '{_FIRST_NUMBER}', 2)) AS scale FROM documents)
SELECT doc_id, TRY_CAST(replace(digits, ',', '') AS DOUBLE) * CASE scale WHEN 'hundred' THEN 1e2 WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 ELSE 1 END AS number FROM n
""")
def parse_numbers(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.parse_number(F.col("text")).alias("number"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, 'tion')) AS INTEGER) AS n, round(1000.0 * len(regexp_extract_all(text, 'tion')) / length(text), 6) AS density FROM documents")
def mention_density(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("tion")).alias("n"), F.round(text.mention_density(F.col("text"), "tion"), 6).alias("density"))


@query("""
WITH c AS (SELECT doc_id, ['forest', 'river', 'hill', 'coast'] AS tags, [len(regexp_extract_all(lower(text), 'the')), len(regexp_extract_all(lower(text), 'and')), len(regexp_extract_all(lower(text), 'sch')), len(regexp_extract_all(lower(text), 'que'))] AS n,
[len(regexp_extract_all(lower(text[1:1500]), 'the')), len(regexp_extract_all(lower(text[1:1500]), 'and')), len(regexp_extract_all(lower(text[1:1500]), 'sch')), len(regexp_extract_all(lower(text[1:1500]), 'que'))] AS lead FROM documents),
u AS (SELECT doc_id, unnest(tags) AS tag, unnest(n) AS n, unnest(lead) AS lead, generate_subscripts(tags, 1) AS i FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS k FROM u WHERE lead >= 1 OR n >= 3)
SELECT doc_id, string_agg(tag, ',' ORDER BY k) AS tags FROM r WHERE k <= 3 GROUP BY 1
""")
def terrain_tags(t: Tables) -> DataFrame:
    vocabulary = (("forest", "the"), ("river", "and"), ("hill", "sch"), ("coast", "que"))

    def tags(low: Column) -> Column:
        lead = F.substring(low, 1, 1500)
        found = F.array(*[F.struct((-F.regexp_count(low, F.lit(p))).alias("n"), F.lit(i).alias("i"), F.lit(tag).alias("tag"), F.regexp_count(lead, F.lit(p)).alias("lead")) for i, (tag, p) in enumerate(vocabulary)])
        best = F.slice(F.array_sort(F.filter(found, lambda x: (x["lead"] >= 1) | (x["n"] <= -3))), 1, 3)
        return F.array_join(F.transform(best, lambda x: x["tag"]), ",")

    # exploded rather than filtered: a filter would be moved below the projection and count everything again
    told = F.transform(F.array(F.lower("text")), tags)
    return t.documents.select("doc_id", F.explode(F.filter(told, lambda x: x != "")).alias("tags"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host, regexp_matches(lower(regexp_extract(url, '://([^/:?#]+)', 1)), '(^|\.)(com|org)$') AS allowed FROM pages")
def url_host_allow(t: Tables) -> DataFrame:
    host = text.url_host(F.col("url"))
    return t.pages.select("page_id", host.alias("host"), text.host_allowed(host, ["com", "org"]).alias("allowed"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT DISTINCT page_id, href FROM l""")
def html_links(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("href"))
    return found.distinct()


@query(r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
n AS (SELECT page_id, regexp_replace(trim(href), '#.*$', '') AS link, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS root, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) AS scheme, regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^/])/[^/]*$', '\1') AS folder FROM l),
r AS (SELECT page_id, CASE WHEN link = '' OR regexp_matches(link, '(?i)^(mailto|javascript|data|tel):') THEN NULL WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN scheme || link WHEN starts_with(link, '/') THEN root || link ELSE folder || '/' || link END AS link FROM n)
SELECT DISTINCT page_id, link FROM r WHERE page_id IS NOT NULL AND link IS NOT NULL
""")
def resolved_links(t: Tables) -> DataFrame:
    links = t.pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.select("page_id", text.normalise_url(F.col("href"), F.col("url")).alias("link")).dropna().distinct()


@query("SELECT page_id, sha256(html) AS content_hash, substr(sha256(url), 1, 10) AS url_id FROM pages")
def content_hashes(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2("html", 256).alias("content_hash"), text.short_id(F.col("url")).alias("url_id"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.none') AS DOUBLE), -1) AS missing, CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events")
def json_path_gate(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select("event_id", text.json_number(p, "$.k").alias("k"), text.json_number(p, "$.none", -1.0).alias("missing"), text.json_key_count(p).alias("n_keys"))


@query("WITH h AS (SELECT event_id, ts, sha256(event_type || '|' || CAST(user_id AS VARCHAR)) AS h FROM events) SELECT h, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM h GROUP BY 1")
def request_cache(t: Tables) -> DataFrame:
    h = t.events.select("event_id", "ts", F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256).alias("h"))
    return h.groupBy("h").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN 'licence' WHEN regexp_matches(text, '(?i)the than') THEN 'than' WHEN regexp_matches(text, '\d') THEN 'digits' ELSE 'other' END AS label FROM documents
""")
def keyword_cascade(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.keyword_class(F.col("text"), (("license", "licence"), ("the than", "than"), (r"\d", "digits")), "other").alias("label"))


@query("""
SELECT o_orderkey, CAST(CASE WHEN y < 500 THEN 0 WHEN y < 1500 THEN 1 WHEN y < 1800 THEN 2 WHEN y < 1900 THEN 3 WHEN y IS NULL THEN 5 ELSE 4 END AS INTEGER) AS bin, CASE WHEN y IS NULL THEN 'undated' WHEN y < 500 THEN 'ancient' WHEN y < 1500 THEN 'medieval' WHEN y < 1800 THEN 'early' ELSE 'late' END AS era,
CAST(y < 500 AS DOUBLE) AS flag FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderkey % 2000 AS INTEGER) END AS y FROM orders)
""")
def era_bins(t: Tables) -> DataFrame:
    y = F.when(F.col("o_orderkey") % 11 > 0, (F.col("o_orderkey") % 2000).cast("int"))
    return t.orders.select("o_orderkey", maths.right_open_bin(y, (500, 1500, 1800, 1900)).alias("bin"), maths.named_era(y, ((500, "ancient"), (1500, "medieval"), (1800, "early")), "late", "undated").alias("era"), maths.flag_before(y, 500).alias("flag"))


@query("SELECT l_orderkey, l_linenumber, round(exp(ln(l_extendedprice) - 0.2), 4) AS low, round(exp(ln(l_extendedprice) + 0.3), 4) AS high, round((4 + 1) / ((4 + 3) * l_quantity * l_quantity), 9) AS information, round(0.5 + 0.42 * (l_quantity + 50 - 85) / 15, 3) AS confidence FROM lineitem")
def scalar_arithmetic(t: Tables) -> DataFrame:
    w = maths.widen(F.col("l_extendedprice"), F.col("l_extendedprice"), 0.2, 0.3)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(w["low"], 4).alias("low"), F.round(w["high"], 4).alias("high"), F.round(maths.fisher_information(F.col("l_quantity"), 4), 9).alias("information"), maths.fuzzy_confidence(F.col("l_quantity") + 50, 85).alias("confidence"))


@query(r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split_regex(text, '(?i)<br\s*/?>|[\n•*]+'), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS items FROM documents")
def list_items(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.list_items(F.col("text"))).alias("items"))
