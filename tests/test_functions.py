import math

import pytest
from pyspark.sql import functions as F

from talweg.functions import maths, ordinal, text


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for i, v in enumerate(values)))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


TITLES = ["general", "prince", "king", "general of the army"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.fold_name, "The Éblouissant, Ñandú!", "eblouissant nandu"),
        (text.fold_name, None, None),
        (text.fold_name, "", ""),
        (text.squashed, "Van der  Berg", "vanderberg"),
        (text.tidy, "  a  b , c ) ", "a b, c)"),
        (text.clean_surface, "Commander: John† (WIA) Smith [1]", "John Smith"),
        (lambda c: text.strip_titles(c, TITLES), "general prince eugene", "eugene"),
        (text.uninvert, "Smith, John", "John Smith"),
        (text.uninvert, "a, b, c", "a, b, c"),
        (lambda c: text.name_keys(c, TITLES), "Prince Eugene of Savoy", ["prince eugene of savoy", "eugene of savoy", "eugene"]),
        (text.strip_markup, "'''A''' [[B|b]] [[C]]<ref>x</ref> {{t|1}} <b>d</b>", "A b C d"),
        (text.list_items, "a<br/>b\n* c\n\n", ["a", "b", "c"]),
        (text.parse_number, "about 1.5 million men", 1.5e6),
        (text.parse_number, "12,345 in all", 12345.0),
        (text.parse_number, "none", None),
        (text.url_host, "https://u@En.Example.org:80/x", "en.example.org"),
        (text.url_host, "not a url", None),
        (text.title_from_url, "https://x.org/wiki/Some_%C3%A9t%C3%A9?x=1", "Some été"),
        (text.json_key_count, '{"a": 1, "b": {}}', 2),
        (text.json_key_count, "nothing", 0),
        (lambda c: text.mention_density(c, "ab"), "abab", 500.0),
        (lambda c: text.mention_density(c, "ab"), "", 0.0),
        (maths.astronomical_year, "0210-01-01 BC", -209),
        (maths.astronomical_year, "1815-06-18", 1815),
        (maths.signed_time_year, "-0044-03-15T00:00:00Z", -43),
        (lambda c: maths.title_years(c)["last"], "Siege of X (1914–18)", 1918),
        (lambda c: maths.title_years(c)["first"], "Siege of X (480)", 480),
        (maths.date_slack, "century", 100),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


def test_links(spark):
    base = "https://x.org/a/b.html"
    for href, want in (("//y.org/c", "https://y.org/c"), ("/d", "https://x.org/d"), ("e?q#f", "https://x.org/a/e?q"), ("mailto:z", None), ("#top", None), ("http://w.org", "http://w.org")):
        assert one(spark, text.normalise_url, href, base) == want
    assert one(spark, lambda h: text.host_allowed(h, ["example.org"]), "en.example.org") is True
    assert one(spark, lambda h: text.host_allowed(h, ["example.org"]), "badexample.org") is False
    assert one(spark, lambda h: text.host_allowed(h, ["example.org"]), None) is False


def test_number_ranges_and_labels(spark):
    assert tuple(one(spark, text.number_range, "between 1,000 and 2,500 men")) == (1000.0, 2500.0)
    assert tuple(one(spark, text.number_range, "900-300")) == (None, None)
    markers = {"staff": "muster", "claim": "claimed"}
    for value, figure, want in (("muster roll 500", "500", "staff"), ("claimed 500, long after that a muster was 20", "500", "claim"), ("claimed or a muster", "500", "none"), ("[muster] 500", "500", "none"), ("x", "x", "none")):
        assert one(spark, lambda a, b: text.nearest_label(a, b, markers, "none"), value, figure) == want
    assert one(spark, text.levenshtein_ratio, "abcd", "abce") == 75.0
    assert one(spark, text.levenshtein_ratio, "", "") == 100.0
    assert one(spark, lambda a, b: text.coalesce_label(a, b, default="unknown"), "  ", None) == "unknown"


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (maths.roundness, 12000.0, 0.75), (maths.roundness, 7.0, 0.0), (maths.roundness, float("nan"), 0.0), (maths.roundness, -500.0, 1.0), (maths.roundness, 123.0, 0.0),
        (lambda c: maths.floor_bin(c, 100), -50.0, -100), (lambda c: maths.right_open_bin(c, (500, 1500)), 500.0, 1), (lambda c: maths.right_open_bin(c, (500, 1500)), 1500.0, 2),
        (lambda c: maths.flag_before(c, 500), 499.0, 1.0), (lambda c: maths.fuzzy_confidence(c, 85), 100.0, 0.92),
    ],
)
def test_maths(spark, f, value, want):
    assert one(spark, f, value) == pytest.approx(want)


def test_intervals(spark):
    assert one(spark, maths.overlap_share, 0.0, 2.0, 1.0, 5.0) == 0.5
    assert one(spark, maths.overlap_share, 0.0, 2.0, 1.0, 1.0) == 1.0
    assert one(spark, maths.overlap_share, 0.0, 2.0, 3.0, 3.0) == 0.0
    low, high = one(spark, lambda k, n: maths.wilson(k, n), 8, 10)
    assert (low, high) == pytest.approx((0.4901625, 0.9433178), abs=1e-6)
    assert tuple(one(spark, lambda k, n: maths.wilson(k, n), 0, 0)) == (None, None)
    w = spark.sql("select array(0.0D, 0.0D) a, array(1.0D, 2.0D, 7.0D) b, cast(array() as array<double>) c").select(*[maths.normalised_weights(F.col(c)).alias(c) for c in "abc"]).first()
    assert w["a"] == [0.5, 0.5] and sum(w["b"]) == 1.0 and w["b"][0] == 0.1 and w["c"] == []


def test_ordinal_identities(spark):
    c1, c2 = 0.3, 1.2
    for eta in (-3.0, 0.0, 0.7):
        probs = one(spark, lambda e: ordinal.category_probs(e, c1, c2), eta)
        assert sum(probs) == pytest.approx(1)
        win, even, loss = one(spark, lambda e: ordinal.outcome_probs(e, c1), eta)
        assert (win, even, loss) == pytest.approx((probs[3] + probs[4], probs[2], probs[0] + probs[1]))
        assert one(spark, lambda e: ordinal.expected_score(e, c1), eta) == pytest.approx(win + even / 2)
        assert one(spark, lambda e: ordinal.interval_probability(e, F.lit(1), F.lit(3), c1, c2), eta) == pytest.approx(sum(probs[1:4]))
        cumulative = [sum(probs[: i + 1]) for i in range(4)]
        assert one(spark, lambda e: ordinal.ranked_probability_score(ordinal.category_probs(e, c1, c2), F.lit(2)), eta) == pytest.approx(sum((p - (2 <= i)) ** 2 for i, p in enumerate(cumulative)) / 4)
    assert one(spark, lambda e: ordinal.log_likelihood(e, F.lit(0), F.lit(0), c1, c2), 80.0) == pytest.approx(math.log(1e-12))
