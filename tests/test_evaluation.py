import pytest
from pyspark.sql import functions as F

from talweg.operators import evaluation


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_completed_data(spark):
    v = frame(spark, [(0, 1, 10, 1.0, True, "a"), (0, 1, 11, 6.0, False, "a"), (1, 1, 10, 2.0, True, "a"), (1, 1, 11, 6.0, False, "a")], "r int, e int, s int, v double, imp boolean, era string")
    one = lambda df: df.first()["passed"]
    assert one(evaluation.completeness(v, ["r", "s"], "v", 2, 2)) and not one(evaluation.completeness(v, ["r", "s"], "v", 3, 2))
    assert not one(evaluation.completeness(v.withColumn("v", F.lit(float("nan"))), ["r", "s"], "v", 2, 2))
    assert evaluation.ratio_plausible(v, "r", "e", "v", "imp").first()["largest"] == 4.5
    assert not one(evaluation.ratio_plausible(v, "r", "e", "v", "imp")) and one(evaluation.ratio_plausible(v, "r", "e", "v", "imp", 4.6)) and one(evaluation.ratio_plausible(v.limit(0), "r", "e", "v", "imp"))
    assert one(evaluation.values_plausible(v, "v", F.col("imp"), 2.0, 8.0)) and not one(evaluation.values_plausible(v, "v", F.col("imp"), 2.0, 7.0))
    pairs = frame(spark, [(e, s, float(e * (s + 1)), 2.0 * e * (s + 1)) for e in range(12) for s in (0, 1)], "e int, s int, v double, rep double")
    assert evaluation.pair_slope(pairs, "e", "s", "v", "rep").first()["slope"] == pytest.approx(0.5)
    assert not one(evaluation.pair_slope(pairs, "e", "s", "v", "rep")) and one(evaluation.pair_slope(pairs, "e", "s", "v", "rep", reference=0.45)) and one(evaluation.pair_slope(pairs.filter("e < 5"), "e", "s", "v", "rep"))
    assert one(evaluation.side_slope(pairs.limit(3), "v", "rep")) and not one(evaluation.side_slope(pairs, "v", "rep"))
    wide = frame(spark, [(0, "a", float(i + 100 * (i % 2)), i % 2 == 0) for i in range(60)] + [(0, "b", 1.0, True)], "r int, era string, v double, imp boolean")
    assert [(r["era"], r["passed"]) for r in evaluation.distributional(wide, "r", "era", "v", F.col("imp")).collect()] == [("a", False)]


def test_rankings(spark):
    a = frame(spark, [(i, float(-i)) for i in range(10)], "k int, score double")
    b = frame(spark, [(i, float(i)) for i in range(5, 15)], "k int, score double")
    got = evaluation.rank_agreement(a, b, "k", "score", 3).first()
    assert (got["shared"], got["either"], got["n"], round(got["rho"], 6)) == (0, 6, 5, -1.0)
    entries = frame(spark, [(1, 5.0, -3.0, 1800), (1, -1.0, 0.0, 1870), (2, 1.0, 0.0, 1800), (3, 9.0, -9.0, 1700)], "k int, v double, ratio double, y int")
    top = frame(spark, [(1,), (2,)], "k int")
    assert [r["k"] for r in evaluation.concentration(entries, "k", "v", F.col("ratio") < -2, top).collect()] == [1]
    assert [r["k"] for r in evaluation.long_careers(entries, "k", "y").collect()] == [1]
    assert [r["k"] for r in evaluation.uncredited(frame(spark, [(1, 1, 3), (2, 4, 1), (3, 0, 9)], "k int, inc int, un int"), "k", "inc", "un", top).collect()] == [1]
    wanted = frame(spark, [("q1", 1, 3), ("q2", 1, 3), ("q3", 1, 3)], "q string, low int, high int")
    ranking = frame(spark, [("q1", 2), ("q2", 9)], "q string, rank int")
    assert {r["q"]: r["status"] for r in evaluation.expert_checks(wanted, ranking, "q").collect()} == {"q1": "passed", "q2": "failed", "q3": "not_evaluable"}
    simulated = frame(spark, [(0, d, d / 100) for d in range(101)], "level int, draw int, share double")
    observed = frame(spark, [(0, 0.5), (1, 0.2)], "level int, share double")
    got = evaluation.category_check(simulated, observed.withColumnRenamed("share", "seen"), "level", "share", "seen", "draw")
    assert {r["level"]: r["passed"] for r in got.collect()} == {0: True, 1: False}


def test_publication(spark):
    results = frame(spark, [("a", "error", True), ("b", "error", False), ("c", "warning", False)], "name string, severity string, passed boolean")
    assert evaluation.provisional_reasons(results).first()["reasons"] == ["b"]
    x, y = frame(spark, [(1,), (1,), (2,)], "v int"), frame(spark, [(1,), (3,)], "v int")
    assert sorted(tuple(r) for r in evaluation.same_rows(x, y).collect()) == [(1, "first"), (2, "first"), (3, "second")]
    share = evaluation.running_share(frame(spark, [("k", 1, 1.0), ("k", 2, 3.0)], "k string, o int, v double"), "o", "v", ["k"]).orderBy("o").collect()
    assert [r["running"] for r in share] == [0.25, 1.0]
