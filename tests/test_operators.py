import pytest
from pyspark.sql import functions as F

from talweg.operators import aggregates, claims, credit, gates, graph, identity, relational, windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_banded_and_overlapping_pairs(spark):
    df = frame(spark, [(1, "x", 10), (2, "x", 12), (3, "x", 13), (4, "y", 12), (5, "x", None), (6, "x", -1), (7, "x", 1)], "id int, k string, v int")
    assert rows(relational.banded_pairs(df, "id", ["k"], "v", 2).select("a", "b")) == [(1, 2), (2, 3), (6, 7)]
    assert rows(relational.banded_pairs(df, "id", ["k"], "v", 0).select("a", "b")) == []
    r = frame(spark, [(1, "x", 0, 5), (2, "x", 5, 9), (3, "x", 4, 6), (4, "x", None, None)], "id int, k string, lo int, hi int")
    assert rows(relational.overlapping_pairs(r, "id", ["k"], "lo", "hi").select("a", "b")) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_upsert_is_idempotent(spark):
    old = frame(spark, [(1, "a", None), (2, "b", "x")], "k int, role string, note string")
    new = frame(spark, [(2, "c", None), (3, "d", "y")], "k int, role string, note string")
    how = {"role": "old", "note": "prefer"}
    once = relational.upsert(old, new, ["k"], how)
    assert rows(once) == [(1, "a", None), (2, "b", "x"), (3, "d", "y")]
    assert rows(relational.upsert(once, new, ["k"], how)) == rows(once)
    assert rows(relational.upsert(old.limit(0), new, ["k"])) == rows(new)
    assert rows(relational.remove_stale(old, new.limit(0), ["k"])) == rows(old)
    assert rows(relational.remove_stale(old, new, ["k"], F.col("role") == "a")) == [(1, "a", None), (2, "b", "x")]
    assert rows(relational.replace_owned(old, new, F.col("note") == "x")) == [(1, "a", None), (2, "c", None), (3, "d", "y")]


def test_sessions_send_undated_rows_to_the_largest(spark):
    df = frame(spark, [("n", 1, 1700), ("n", 2, 1710), ("n", 3, 1900), ("n", 4, None), ("m", 5, None), ("n", 6, 1770)], "g string, id int, y int")
    assert rows(windows.sessions(df, ["g"], "y", 60, "id").select("id", "session")) == [(1, 0), (2, 0), (3, 1), (4, 0), (5, 0), (6, 0)]


def test_ranks(spark):
    df = frame(spark, [(i, float(v)) for i, v in ((1, 2), (2, 2), (3, "nan"), (4, 9), (5, -1))] + [(6, None)], "id int, v double")
    assert rows(windows.ranked_descending(df, "v", "id").select("id", "rank")) == [(1, 2), (2, 3), (3, 5), (4, 1), (5, 4), (6, 6)]
    many = spark.range(1000).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("v"))
    got = windows.ranked_descending(many, "v", "id", 7).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [(r["v"], r["id"]) for r in got] == sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    s = frame(spark, [("a", 1.0, 5.0), ("a", 2.0, 6.0), ("a", 3.0, 7.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 3.0, 1.0), ("c", 1.0, 2.0)], "g string, x double, y double")
    assert rows(windows.spearman(s, ["g"], "x", "y")) == [("a", 3, pytest.approx(1.0)), ("b", 3, None), ("c", 1, None)]


def test_group_rules(spark):
    df = frame(spark, [(1, "s", True, "infantry", 5.0), (2, "s", None, "total", 50.0), (3, "t", False, "infantry", 7.0), (4, "t", False, "infantry", 0.0)], "id int, side string, good boolean, kind string, v double")
    assert [r[0] for r in rows(windows.keep_unless_group(df, ["side"], F.col("good")))] == [1, 3, 4]
    assert rows(windows.lone_kind(df, ["side"], "kind", "total", ["infantry", "cavalry"]).select("id", "kind", "promoted")) == [(1, "infantry", False), (2, "total", False), (3, "total", True), (4, "total", True)]
    assert rows(windows.span_guard(df, ["side"], "v").select("side", "severity")) == [("s", "error")]
    packed = frame(spark, [(1, "g", 4), (2, "g", 4), (3, "g", 20), (4, "g", 1)], "at int, g string, n int")
    assert rows(windows.packed(packed, ["g"], "at", "n", 10).select("at", "chunk")) == [(1, 0), (2, 0), (3, 1), (4, 2)]


def test_claims(spark):
    df = frame(spark, [(1, "s", "wiki", 1000.0), (2, "s", "info", 1005.0), (3, "s", "book", 1000.0), (4, "t", "wiki", 1000.0), (5, "s", "wiki", None)], "id long, side string, src string, v double")
    lineages = claims.lineages(df, ["side"], "id", "v", F.col("src") == "wiki", F.col("src") == "info")
    assert rows(lineages.select("id", "lineage")) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    assert [r[0] for r in rows(claims.collapse_lineages(lineages, "id", F.col("src") == "wiki").select("id"))] == [2, 3, 4, 5]
    r = frame(spark, [(1, "a", 100.0, True, False), (2, "a", 400.0, False, True), (3, "b", 9.0, True, False), (4, "a", 7.0, False, False), (5, None, 1.0, True, False), (6, None, 4.0, False, True)], "id long, k string, v double, lo boolean, hi boolean")
    got = claims.merge_ranges(r, ["k"], "id", "v", F.col("lo"), F.col("hi")).select("id", "v", "range_var", "merged")
    import math

    assert rows(got) == [(1, 200.0, pytest.approx((math.log(4) / 4) ** 2), True), (3, 9.0, 0.0, False), (4, 7.0, 0.0, False), (5, 2.0, pytest.approx((math.log(4) / 4) ** 2), True)]


def test_weights(spark):
    data = [("a", 1, "field"), ("b", 1, "field"), ("b", 2, "supreme"), ("b", 3, "theatre"), ("b", 4, "subordinate"), ("b", 5, "sovereign"), ("c", 1, "field"), ("c", 2, None), ("d", 1, "supreme")]
    got = credit.side_weights(frame(spark, data, "side string, who int, role string"), ["side"], "who", "role")
    w = {(r["side"], r["who"]): (round(r["weight"], 9), r["method"]) for r in got.collect()}
    assert w["a", 1] == (1.0, "single") and w["c", 1] == (0.5, "default_split") and w["d", 1] == (1.0, "single")
    assert w["b", 1] == (0.7, "rule") and w["b", 2][0] == pytest.approx(0.1 * 0.3 / 0.33)
    assert credit.invalid_sides(got, ["side"], "weight").count() == 0


def test_match_decisions(spark):
    data = [(1, 10, True, True, 80.0), (1, 11, False, True, 99.0), (2, 20, True, None, 1.0), (2, 21, True, True, 1.0), (3, 30, True, None, 1.0), (3, 31, True, None, 1.0), (4, 40, False, None, 92.5), (4, 41, False, None, 80.0), (5, 50, False, None, 90.0), (5, 51, False, None, 88.0), (6, 60, False, False, 99.0), (7, 70, False, None, 71.0), (8, 80, False, None, 10.0)]
    pairs = frame(spark, data, "g int, c int, exact boolean, dated boolean, score double")
    got = rows(identity.decisions(pairs, "g", "c", F.col("exact"), F.col("dated"), F.col("score"), F.lit(0)))
    assert got == [(1, "linked", 10, 0.95), (2, "linked", 21, 0.95), (3, "ambiguous", None, None), (4, "linked", 40, 0.71), (5, "ambiguous", None, None), (6, "new", None, 0.6), (7, "ambiguous", None, None), (8, "new", None, 0.6)]


def test_graph(spark):
    edges = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (7, 7)], "a long, b long")
    assert rows(graph.components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7)]
    assert rows(graph.bridges(edges)) == [(3, 4), (5, 6)]
    parents = frame(spark, [("s", 1, 2), ("s", 2, 3), ("s", 3, 1), ("t", 1, 2), ("t", 2, None), ("u", 1, 1)], "side string, n int, p int")
    assert rows(graph.has_cycle(parents, ["side"], "n", "p")) == [("s",), ("u",)]
    assert rows(graph.broken_merges(frame(spark, [(1, 2), (2, 3), (4, 3)], "s int, t int"), "s", "t")) == [(1, 2)]
    top = frame(spark, [(1,), (5,), (9,)], "id long")
    assert rows(graph.outside_largest(top, graph.components(edges), "id").select("id")) == [(5,), (9,)]


def test_pooling_identities(spark):
    draws = frame(spark, [("g", r, float(v)) for r, vs in enumerate(((1, 2, 3), (2, 4, 6))) for v in vs] + [("h", 0, 5.0)], "k string, r int, v double")
    got = {r["k"]: r for r in aggregates.rubin(draws, "k", "r", "v").collect()}
    assert got["g"]["within"] == pytest.approx(2.5) and got["g"]["between"] == pytest.approx(2.0) and got["g"]["total"] == pytest.approx(2.5 + 1.5 * 2)
    assert got["h"]["total"] == 0 and got["h"]["fmi"] == 0
    shares = aggregates.softmax_share(frame(spark, [("a", None), ("a", None), ("b", 1.0), ("b", 1.0), ("b", None)], "k string, x double"), ["k"], "x")
    assert [round(r[-1], 6) for r in rows(shares)] == [0.5, 0.5, 0.333333, 0.333333, 0.333333]
    w = aggregates.worst_case(frame(spark, [("a", 1.0, 3), ("a", 2.0, None), ("b", 1.0, 4)], "k string, rhat double, div int"), ["k"], ["rhat"], [], ["div"])
    assert rows(w) == [("a", 2.0, None), ("b", 1.0, 4)]
    assert aggregates.calibration(frame(spark, [(1.0, 1), (0.0, 0)], "p double, y int"), "p", "y", 4).orderBy("bin").select("n").collect() == [(1,), (0,), (0,), (1,)]


def test_gates(spark):
    t = {"x": frame(spark, [(1, True), (2, False)], "v int, ok boolean")}
    specs = [
        gates.Gate("n", ">= 2", "error", lambda t: gates.rows(t["x"])), gates.Gate("share", "> {params.least}", "error", lambda t: gates.share(t["x"], F.col("ok"))),
        gates.Gate("none", "!= 5", "warning", lambda t: t["x"].limit(0).agg(F.avg("v").alias("a"))), gates.Gate("empty", "= 1", "error", lambda t: gates.share(t["x"].limit(0), F.col("ok"), 1.0)),
    ]
    got = gates.run(specs, t, {"least": 0.5})
    assert {r["name"]: r["passed"] for r in got.collect()} == {"n": True, "share": False, "none": False, "empty": True}
    assert [r["name"] for r in gates.blocking(got).collect()] == ["share"]
    with pytest.raises(ValueError):
        gates.parse_threshold("about 3")
    runs = frame(spark, [(1, "m", "2020", '{"rhat": 1.2}'), (2, "m", "2021", '{"rhat": 1.01, "gates": {"fit": {"passed": true}}}'), (3, "m", None, '{"rhat": 9}')], "run_id int, model_type string, completed_at string, diagnostics string")
    assert gates.newest_json(runs, "m", "$.rhat").first()[0] == 1.01
    assert gates.newest_json(runs, "z", "$.rhat", 1000.0).first()[0] == 1000.0
    assert gates.stored_verdict(runs.filter("run_id < 3"), "m", "fit").first()[0] == 1.0


def test_empty_tables(spark):
    empty = frame(spark, [], "id long, k string, v double")
    assert rows(aggregates.agreement(empty, ["k"], "v")) == []
    assert rows(windows.sessions(empty, ["k"], "v", 1, "id")) == []
    assert rows(windows.ranked_descending(empty, "v", "id")) == []
    assert rows(relational.banded_pairs(empty, "id", ["k"], "v", 1)) == []
    assert rows(graph.components(empty.select(F.col("id").alias("a"), F.col("id").alias("b")))) == []
    assert rows(claims.lineages(empty, ["k"], "id", "v", F.lit(True), F.lit(True))) == []
