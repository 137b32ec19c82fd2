"""Readers and writers of the formats that event corpora come in.

Schemas are stated, never inferred. Readers go through Spark's file sources, so
any store that Spark reads will do; writers go through Spark's commit protocol,
so a reader never sees half a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions import text

_BINDINGS = "struct<results: struct<bindings: array<map<string, struct<type: string, value: string>>>>>"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that don't parse go (``count_bad_lines`` tells how many)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def count_bad_lines(spark: SparkSession, path: str, schema: str) -> int:
    """Lines that aren't blank and don't parse under the schema."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.filter(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()).count()


def write_json_lines(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Append rows as JSON lines, a folder for each value of ``by``."""
    df.write.mode("append").partitionBy(*by).json(path)


def read_query_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, name, value): variables bound by SPARQL JSON results, a file to a payload; malformed ones give no rows."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.col("value").alias("payload"), F.input_file_name().alias("file"))
    return bindings(whole, "payload").select("file", "row", "name", "value")


def bindings(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with (row, name, value) for each bound variable of a SPARQL JSON result."""
    parsed = df.withColumn("__r", F.from_json(payload, _BINDINGS)["results"]["bindings"])
    rows = parsed.select("*", F.posexplode("__r").alias("row", "__b"))
    return rows.select(*df.columns, "row", F.explode("__b").alias("name", "__v")).select(*df.columns, "row", "name", F.col("__v.value").alias("value"))


def read_entities(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    """(id, label, aliases, claims) of entity JSON files; claims map a property to its values' JSON."""
    whole = spark.read.option("wholetext", "true").text(path)
    value = F.get_json_object("value", "$.entities")
    entity = F.from_json(value, "map<string, string>")
    rows = whole.select(F.explode(F.coalesce(entity, F.from_json(F.lit("{}"), "map<string, string>"))).alias("id", "body"))
    names = F.from_json(F.get_json_object("body", f"$.aliases.{language}"), "array<struct<value: string>>")
    return rows.select(
        "id", F.get_json_object("body", f"$.labels.{language}.value").alias("label"),
        F.coalesce(F.transform(names, lambda n: n["value"]), F.array().cast("array<string>")).alias("aliases"),
        F.from_json(F.get_json_object("body", "$.claims"), "map<string, array<string>>").alias("claims"),
    )


def first_claim(claims: Column, name: str, path: str) -> Column:
    """A value at a JSON path within a property's first claim."""
    return F.get_json_object(F.try_element_at(F.try_element_at(claims, F.lit(name)), F.lit(1)), path)


def page_links(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """(id, link): distinct links of each page, resolved against its URL."""
    found = pages.select(F.col(id_col).alias("id"), F.col(url).alias("base"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1)))).alias("href"))
    return found.select("id", text.normalise_url(F.col("href"), F.col("base")).alias("link")).dropna().distinct()


def cited_links(pages: DataFrame, id_col: str, url: str, html: str, allowed: Sequence[str]) -> DataFrame:
    """(id, link, host, allowed, citation_id): links that leave the page's host, split by an allow-list."""
    links = page_links(pages, id_col, url, html).join(pages.select(F.col(id_col).alias("id"), text.url_host(F.col(url)).alias("own")).distinct(), "id")
    told = links.withColumn("host", text.url_host(F.col("link"))).filter(F.col("host").isNotNull() & ~F.col("host").eqNullSafe(F.col("own")))
    return told.select("id", "link", "host", text.host_allowed(F.col("host"), allowed).alias("allowed"), text.short_id(F.col("link")).alias("citation_id"))


def write_rounds(df: DataFrame, path: str) -> None:
    """Completed data sets, a folder to a round."""
    df.write.mode("overwrite").partitionBy("round").parquet(path)


def read_rounds(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """Rounds written by ``write_rounds``; ``most`` keeps those with the smallest numbers."""
    df = spark.read.schema(f"{schema}, round int").parquet(path)
    return df if most is None else df.filter(F.col("round") < most)


def check_one_run(df: DataFrame, run_col: str, expected: int | None = None) -> None:
    """Raise unless all rows come from one run, the expected one if given."""
    runs = [r[0] for r in df.select(run_col).distinct().limit(3).collect()]
    if len(runs) != 1 or (expected is not None and runs[0] != expected):
        raise ValueError(f"rows of runs {runs}, expected {'one run' if expected is None else expected}")


def discover(spark: SparkSession, root: str, kinds: Sequence[str]) -> DataFrame:
    """(slug, one column per kind): files of the kinds' folders, joined by the name without suffixes."""
    files = None
    for k in kinds:
        one = spark.read.format("binaryFile").load(f"{root}/{k}").select(F.lit(k).alias("kind"), "path")
        files = one if files is None else files.union(one)
    slug = F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z0-9]+)+$", 1)
    return files.groupBy(slug.alias("slug")).pivot("kind", list(kinds)).agg(F.min("path"))


def file_counts(spark: SparkSession, root: str) -> DataFrame:
    """(folder, files, bytes) below a root, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def write_csv(df: DataFrame, path: str, places: int | None = None) -> None:
    """CSV with a header; doubles to fixed places where asked."""
    out = df if places is None else df.select(*[F.format_string(f"%.{places}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    out.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def nested_export(actors: DataFrame, details: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``actors`` with their details as an array of structs in order, ready for JSON."""
    rest = [c for c in details.columns if c not in (key, order)]
    lists = details.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))
    return actors.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds to wait from a Retry-After header, as a number or an HTTP date; null for neither, never below 0."""
    date = F.try_to_timestamp(F.regexp_extract(header, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(F.trim(header).try_cast("double"), (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.when(seconds < 0, 0.0).otherwise(seconds)


def allowed_by_robots(pages: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """``pages`` with ``allowed``: the longest matching path rule (host, path, allow) decides, no rule allows.

    ``rules`` holds a row per host and path prefix.
    """
    told = pages.withColumn("__host", text.url_host(F.col(url))).withColumn("__path", F.coalesce(F.nullif(F.regexp_extract(url, r"^[^:]+://[^/]+(/[^#]*)", 1), F.lit("")), F.lit("/")))
    per_host = rules.groupBy(F.col("host").alias("__host")).agg(F.collect_list(F.struct(F.length("path").alias("n"), F.col("allow"), F.col("path"))).alias("__rules"))
    joined = told.join(per_host, "__host", "left")
    fits = F.filter("__rules", lambda r: F.startswith(F.col("__path"), r["path"]))
    return joined.withColumn("allowed", F.coalesce(F.array_max(fits)["allow"], F.lit(True))).drop("__host", "__path", "__rules")


