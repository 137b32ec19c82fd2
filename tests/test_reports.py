"""Operators of reports, labels, gates and settings on odd rows."""

import pytest
from pyspark.sql import functions as F

from talweg.functions import labels, maths
from talweg.operators import config, gates, reports


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_names_and_titles(spark):
    df = spark.createDataFrame([("Battle of the Nile",), ("Siege of",), ("Battle of Second Manassas",), ("Waterloo",), (None,)], "t string")
    assert values(df, labels.core_name(F.col("t"))) == ["nile", "siege of", "second manassas", "waterloo", None]
    assert values(df, labels.ordinal(F.col("t"))) == [None, None, "second", None, None]
    df = spark.createDataFrame([("Battle of X",), ("File: Battle of X",), ("List of battles",), ("Naval  action at Y",), ("Duke",), (" ",), (None,), ("Operation: Z",)], "t string")
    assert values(df, labels.is_engagement_title(F.col("t"))) == [True, False, False, True, False, False, False, True]
    df = spark.createDataFrame([("[[Category:A|k]] [[ category : B]] [[Category:A]]",), ('<a href="/wiki/Category:C_d%20e">x</a>',), ("",), (None,)], "t string")
    assert values(df, labels.categories(F.col("t"))) == [["A", "B"], ["C d e"], [], None]
    df = spark.createDataFrame([(" Q1 ", "x"), ("  ", " y "), (None, None)], "a string, b string")
    assert values(df, labels.polity_key(F.col("a"), F.col("b"))) == ["Q1", "y", "unknown"]


def test_figures(spark):
    rows = [(85.0, "85-200 war elephants"), (200.0, "85–200 war elephants"), (20000.0, "20,000 men on ships"), (2000.0, "2,000 tank crews"), (100.0, "30,000 men, 100 cannon"), (30000.0, "30,000 men, 100 cannon"), (4.0, "Luftflotte 4"), (1.0, None)]
    df = spark.createDataFrame(rows, "v double, c string")
    assert values(df, labels.counts_things(F.col("v"), F.col("c"))) == [True, True, False, False, True, False, True, False]
    rows = [(60000.0, "90,000 men (60,000 Italian, 30,000 German)"), (90000.0, "90,000 men (60,000 Italian)"), (5.0, "(5) 5 9"), (5.0, "(5) 3"), (1.0, None)]
    df = spark.createDataFrame(rows, "v double, c string")
    assert values(df, labels.is_bracketed_part(F.col("v"), F.col("c"))) == [True, False, False, False, False]
    df = spark.createDataFrame([("16-17 October 1813:",), ("13 March: 28,000",), ("On 1 March :",), (None,)], "c string")
    assert values(df, labels.date_label_numbers(F.col("c"))) == [[16.0, 17.0, 1813.0], None, [1.0], None]


def test_thresholds_and_settings(spark):
    assert gates.parse_threshold("= true") == ("=", 1.0) and gates.parse_threshold("!= FALSE") == ("!=", 0.0)
    assert gates.parse_threshold("p > 0.01") == (">", 0.01) and gates.parse_threshold("<= {params.x}", {"x": 3}) == ("<=", 3.0)
    for bad in ("", "true", ">= yes", "q > 1"):
        with pytest.raises(ValueError):
            gates.parse_threshold(bad)
    base = {"a": {"b": 1, "c": {"d": 2}}, "e": [1]}
    assert config.merged(base, {"a.c.d": 3, "a": {"b": {"x": 1}}, "e": [2], "f.g": 4}) == {"a": {"b": {"x": 1}, "c": {"d": 3}}, "e": [2], "f": {"g": 4}}
    assert base == {"a": {"b": 1, "c": {"d": 2}}, "e": [1]}
    assert maths.z_for_level(0.95) == pytest.approx(1.959964, abs=1e-6)


def test_empty_and_null_rows(spark):
    none = spark.createDataFrame([], "k long, v double, s string, r int")
    assert reports.ranks_in_gaps(none, none, "r").collect()[0][0] == 0
    assert reports.larger_wins(none, F.col("v"), F.col("v") > 0).collect()[0][0] == 0
    assert reports.sweep(none, "v", "v", F.col("s") == "x", (1,), (1,)).collect() == []
    odd = spark.createDataFrame([(1, None, None, None), (1, float("nan"), "", 1), (None, 2.0, "a", 2)], "k long, v double, s string, r int")
    assert reports.larger_wins(odd, F.col("v"), F.col("v") > 0).collect()[0][0] == 1
    assert {tuple(r) for r in reports.missing_fields(odd, ["k"], {"v": "v?", "s": "s?"}).collect()} == {(1, "v", "v?"), (1, "s", "s?")}
    assert [tuple(r) for r in reports.merged_tags(odd.select("k", "r", F.array("s").alias("t")), "k", F.col("r"), "r", "t").collect()] == [(None, ["a"])]
    assert reports.superseded(odd, ["k"], F.col("s") == "").count() == 2
    kept, told = reports.retired(odd, odd, odd.filter("k = 1"), "k")
    assert kept.count() == 1 and told.filter("k is not null").count() == 0
    assert [r["n"] for r in reports.two_histograms(odd, "v", F.col("s") == "a", 1.0).filter("kind = 'imputed'").collect()] == [1]
