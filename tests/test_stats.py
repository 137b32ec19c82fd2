import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import parse
from talweg.operators import classify, stats


def test_mixture_finds_two_normals(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, 700), r.normal(8, 2, 300)])
    fit = stats.normal_mixture(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 60)
    assert fit["weight"] == pytest.approx(0.7, abs=0.03) and fit["mean_0"] == pytest.approx(0, abs=0.2) and fit["mean_1"] == pytest.approx(8, abs=0.5)
    with pytest.raises(ValueError):
        stats.normal_mixture(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x")


def test_conditional_draws_keep_the_known_and_repeat(spark):
    rows = [("e1", 1, 2.0, 2.5), ("e1", 2, 2.0, None), ("e2", 1, 2.0, None), ("e2", 2, 1.0, None)]
    sides = spark.createDataFrame(rows, "event string, side int, mean double, known double")
    got = stats.conditional_draws(sides, "event", "side", "mean", "known", 1.0, 0.5, 200, 7).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in stats.conditional_draws(sides, "event", "side", "mean", "known", 1.0, 0.5, 200, 7).collect()}
    assert {r["value"] for r in got if (r["event"], r["side"]) == ("e1", 1)} == {2.5}
    mean = lambda e, s: np.mean([r["value"] for r in got if (r["event"], r["side"]) == (e, s)])
    assert mean("e1", 2) == pytest.approx(2.0 + 0.5 * 1 / (1 + 0.25), abs=0.2)
    assert mean("e2", 1) - mean("e2", 2) == pytest.approx(1.0, abs=0.2)


def test_picks(spark):
    draws = spark.createDataFrame([(i, float(i % 97)) for i in range(500)], "id int, v double")
    got = stats.stratified_pick(draws, "v", "id", 10, 1).orderBy("stratum").collect()
    assert sorted(r["round"] for r in got) == list(range(10))
    values = [r["id"] % 97 for r in got]
    assert values == sorted(values)
    assert stats.slot_draws(2, 100, 4) == [(0, 25), (1, 25), (0, 75), (1, 75)]


def test_fills_and_shrinks(spark):
    df = spark.createDataFrame([("a", 1.0, False), ("a", 9.0, True), ("b", None, True), ("c", 3.0, False)], "era string, s double, weak boolean")
    assert sorted((r["era"], r["filled"]) for r in stats.filled_slopes(df, "s", F.col("weak"), "era").collect()) == [("a", 1.0), ("a", 1.0), ("b", 2.0), ("c", 3.0)]
    same = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.0)], "k string, x double, sd double")
    assert {r["shrunk"] for r in stats.shrunk_means(same, ["k"], "x", "sd").collect()} == {1.0}
    ranking = spark.createDataFrame([("x", 1), ("y", 2)], "a string, rank int")
    draws = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 0.0), ("y", 0, 0.5), ("y", 1, 0.5)], "a string, d int, v double")
    assert {r["a"]: r["p_next"] for r in stats.order_probability(draws, ranking, "d", "a", "v").collect()} == {"x": 0.5, "y": None}


@pytest.mark.parametrize(
    ("title", "days", "precision", "want"),
    [
        ("Battle of X", 400, "day", None), ("Siege of X", 700, "day", None), ("Siege of X", 731, "day", "long_siege"), ("Operation Y", 1, "day", "operation"), ("Z campaign", 1, "day", "wider_conflict"), ("Battle of the Z campaign", 1, "day", None),
        ("Invasion of Q", 1, "day", "conquest"), ("Q affair", 181, "day", "long_span"), ("Q affair", 180, None, None), ("Battle of X", 1, "century", "date_precision"), (None, None, None, None),
    ],
)
def test_campaigns(spark, title, days, precision, want):
    df = spark.createDataFrame([(title, days, precision)], "t string, d int, p string")
    assert df.select(classify.campaign_reason(F.col("t"), F.col("d"), F.col("p"))).first()[0] == want


def test_event_types_and_sieges(spark):
    rows = [
        (1, "Siege of X", [], [], None, "siege"), (2, "Battle", ["naval battles"], [], "ships and a fleet", "naval"), (3, "Battle", ["naval battles"], ["infantry"], "infantry cavalry infantry", "field"), (4, "B", [], ["naval", "infantry"], "a landing", "amphibious"),
        (5, "B", ["aerial battles"], [], "x", "aerial"), (6, "B", [], [], None, "unknown"), (7, "B", None, None, "text", "field"), (8, "B", [], [], "guerrilla guerrilla guerrilla", "guerrilla"),
    ]
    df = spark.createDataFrame(rows, "id int, t string, c array<string>, b array<string>, a string, want string")
    got = df.select("id", "want", classify.event_type(F.col("t"), F.col("c"), F.col("b"), F.col("a"), F.lit(None).cast("string"), F.lit(0), F.lit(0)).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    sides = spark.createDataFrame([(1, 1, "City of Acre", "Siege of Acre (1191)"), (1, 2, "Crusaders", "Siege of Acre (1191)"), (2, 1, "Acre", "Battle of Acre"), (2, 2, "x", "Battle of Acre")], "e int, s int, l string, t string")
    assert [tuple(r) for r in classify.siege_defender(sides, "e", "s", "l", "t").collect()] == [(1, 1)]
    p = spark.createDataFrame([(1, 1, "none here"), (1, 2, "Ney rode on"), (1, 3, "then NEY fell"), (2, 1, "abcdef"), (2, 2, "ghi")], "e int, o int, x string")
    got = classify.excerpt(p, "e", "o", "x", F.array(F.lit("Ney")), 14).orderBy("e", "o").collect()
    assert [(r["e"], r["o"], r["x"]) for r in got] == [(1, 2, "Ney rode on"), (1, 3, "the"), (2, 1, "abcdef"), (2, 2, "ghi")]


def test_parsers(spark):
    text = "{{Short}} {{Infobox military conflict\n| conflict = Battle of [[X|the X]]\n| strength1 = {{plainlist|a|b}} 12,000\n| empty =\n}} body"
    assert parse.template_fields(text) == {"conflict": "Battle of [[X|the X]]", "strength1": "{{plainlist|a|b}} 12,000"}
    assert parse.template_fields("no box") == {} and parse.template_fields("{{Infobox x | a = 1") == {}
    assert parse.quantities("about 12,000 infantry") == [(12000.0, False, False, True, "total", "infantry")]
    assert parse.quantities("10,000-15,000 men") == [(10000.0, True, False, True, "total", "total"), (15000.0, False, True, True, "total", "total")]
    assert parse.quantities("1.5 to 2 million") == [(1.5e6, True, False, True, "total", "total"), (2e6, False, True, True, "total", "total")]
    assert parse.quantities("the 3rd of (1805) [1]") == []
    assert parse.quantities("up to 300 killed")[0][:5] == (300.0, False, True, True, "casualties")
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, body string")
    assert sorted(tuple(r) for r in parse.infobox_fields(df, "id", "body").collect()) == [(1, "conflict", "Battle of [[X|the X]]"), (1, "strength1", "{{plainlist|a|b}} 12,000")]
    article = spark.createDataFrame([(1, "lead one\n\nlead two\n== Part ==\n" + "x" * 25 + "\n\ny")], "id long, body string")
    assert [(r["place"], r["section"], r["text"]) for r in parse.passages(article, "id", "body", 20, 2).orderBy("place").collect()] == [(0, "", "lead one\n\nlead two"), (1, "Part", "x" * 20), (2, "Part", "xxxxx\n\ny")]
