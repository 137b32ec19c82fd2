import json

import pytest
from pyspark.sql import functions as F

from talweg.sources import files


def test_json_lines_and_rounds(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\nnot json\n\n{"k": 2}\n')
    assert sorted(r["k"] for r in files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "k int").collect()) == [1, 2]
    assert files.count_bad_lines(spark, str(tmp_path / "a.jsonl"), "k int") == 1
    df = spark.createDataFrame([(1, 0.5, 0), (2, 0.7, 1), (1, 0.6, 10)], "side int, v double, round int")
    files.write_rounds(df, str(tmp_path / "rounds"))
    assert files.read_rounds(spark, str(tmp_path / "rounds"), "side int, v double").count() == 3
    assert files.read_rounds(spark, str(tmp_path / "rounds"), "side int, v double", 2).count() == 2
    files.check_one_run(df.withColumn("run", F.lit(4)), "run", 4)
    with pytest.raises(ValueError):
        files.check_one_run(df, "round")


def test_query_results_and_entities(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q/a.json").write_text(json.dumps({"results": {"bindings": [{"x": {"type": "uri", "value": "Q1"}, "y": {"type": "literal", "value": "b"}}, {"x": {"type": "uri", "value": "Q2"}}]}}))
    (tmp_path / "q/b.json").write_text("{broken")
    assert sorted(tuple(r) for r in files.read_query_results(spark, str(tmp_path / "q")).select("row", "name", "value").collect()) == [(0, "x", "Q1"), (0, "y", "b"), (1, "x", "Q2")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e/Q1.json").write_text(json.dumps({"entities": {"Q1": {"labels": {"en": {"value": "One"}}, "aliases": {"en": [{"value": "Uno"}]}, "claims": {"P1": [{"v": {"time": "-0044"}}]}}}}))
    (r,) = files.read_entities(spark, str(tmp_path / "e")).select("id", "label", "aliases", files.first_claim(F.col("claims"), "P1", "$.v.time").alias("t"), files.first_claim(F.col("claims"), "P2", "$.v").alias("n")).collect()
    assert tuple(r) == ("Q1", "One", ["Uno"], "-0044", None)


def test_links_files_and_exports(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://x.org/a", '<a href="/b">b</a> <a class="q" href="http://sub.ok.org/c">c</a> <a href="http://bad.com">d</a>')], "id int, url string, html string")
    assert sorted(r["link"] for r in files.page_links(pages, "id", "url", "html").collect()) == ["http://bad.com", "http://sub.ok.org/c", "https://x.org/b"]
    assert {r["host"]: r["allowed"] for r in files.cited_links(pages, "id", "url", "html", ["ok.org"]).collect()} == {"sub.ok.org": True, "bad.com": False}
    for kind, names in (("wiki", ("a.txt", "b.wiki.txt")), ("html", ("a.html",))):
        (tmp_path / kind).mkdir()
        for n in names:
            (tmp_path / kind / n).write_text("xy")
    got = {r["slug"]: (r["wiki"] is not None, r["html"] is not None) for r in files.discover(spark, str(tmp_path), ["wiki", "html"]).collect()}
    assert got == {"a": (True, True), "b": (True, False)}
    assert sorted(tuple(r) for r in files.file_counts(spark, str(tmp_path)).collect()) == [("html", 1, 2), ("wiki", 2, 4)]
    files.write_csv(spark.createDataFrame([(1, 0.123456)], "k int, v double"), str(tmp_path / "csv"), 4)
    assert files.read_csv(spark, str(tmp_path / "csv"), "k int, v double").collect() == [(1, 0.1235)]
    nested = files.nested_export(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, at int, n string"), "k", "at", "rows")
    assert {r["k"]: [x["n"] for x in r["rows"]] for r in nested.collect()} == {1: ["a", "b"], 2: []}


def test_headers_and_robots(spark):
    df = spark.createDataFrame([("120",), ("Wed, 01 Jan 2020 00:01:00 GMT",), ("soon",), (None,), ("-5",)], "h string").withColumn("now", F.lit("2020-01-01 00:00:00").cast("timestamp"))
    assert [r["s"] for r in df.select(files.retry_after_seconds(F.col("h"), F.col("now")).alias("s")).collect()] == [120.0, 60.0, None, None, 0.0]
    rules = spark.createDataFrame([("x.org", "/", True), ("x.org", "/private", False)], "host string, path string, allow boolean")
    pages = spark.createDataFrame([("https://x.org/a",), ("https://x.org/private/b",), ("https://y.org/private",)], "url string")
    assert {r["url"]: r["allowed"] for r in files.allowed_by_robots(pages, "url", rules).collect()} == {"https://x.org/a": True, "https://x.org/private/b": False, "https://y.org/private": True}
