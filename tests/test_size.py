"""What keeps the cost of F4 to F7 of round 2 in proportion: no pass per group, repeated name or edge of a dense graph."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import text
from talweg.operators import aggregates, graph, identity, relational, stats


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_run_without_a_python_call_per_event(spark):
    rows = [(e, s, 3.0, None if s else 4.0) for e in range(2000) for s in range(3)] + [(None, 0, 1.0, float("nan")), (-1, 0, None, None)]
    got = stats.conditional_draws(spark.createDataFrame(rows, "e long, s int, m double, k double"), "e", "s", "m", "k", 0.5, 0.8, 4, 11)
    assert "Pandas" not in plan(got) and "Arrow" not in plan(got)
    found = got.collect()
    assert len(found) == 4 * len(rows)
    assert all(r["value"] == 4.0 for r in found if r["s"] == 0 and (r["e"] or 0) > 0)
    assert all(r["value"] is None for r in found if r["e"] == -1) and all(r["value"] is not None for r in found if r["e"] is None)
    at = {(r["round"], r["e"], r["s"]): r["value"] for r in found}
    x, y = (np.array([at[j, e, s] for j in range(4) for e in range(1, 2000)]) for s in (1, 2))
    # given one known value: mean 3 + effect's mean, variance its own plus the effect's, which both missing values share
    precision = 1 / 0.25 + 1 / 0.64
    for v in (x, y):
        assert v.mean() == pytest.approx(3 + 1 / 0.64 / precision, abs=0.05) and v.var() == pytest.approx(0.64 + 1 / precision, abs=0.05)
    assert np.cov(x, y)[0, 1] == pytest.approx(1 / precision, abs=0.05)
    assert abs(np.corrcoef([at[0, e, 1] for e in range(1, 2000)], [at[1, e, 1] for e in range(1, 2000)])[0, 1]) < 0.08


def test_dense_graphs_are_thinned_before_components(spark, monkeypatch):
    edges = [(c * 100 + a, c * 100 + b) for c in range(3) for a in range(40) for b in range(a)] + [(39, 100), (500, 501)]
    seen = []
    components = graph.components
    monkeypatch.setattr(graph, "components", lambda ends: seen.append(ends.count()) or components(ends))
    got = graph.bridges(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(39, 100), (500, 501)}
    assert seen[0] < len(edges) / 2


@pytest.mark.parametrize("values", [[], [None], [2.0], [1.0, 2.0], [0.0] * 50 + [1e-300, 1e300, -1e308, 1.7e308], [float("-inf"), 1.0, float("inf"), float("inf")], [5.0, float("nan"), 7.0], list(np.random.default_rng(1).lognormal(0, 3, 3000))])
def test_quantiles_of_all_rows(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    for share in (0.0, 0.5, 0.9, 1.0):
        got = aggregates.whole_quantile(df, F.col("x"), share, bins=16)
        want = df.agg(F.percentile("x", F.lit(share))).first()[0]
        assert got == want or (math.isnan(got) and math.isnan(want)) or got == pytest.approx(want, rel=1e-12)


def test_gate_results_hold_no_buffer_of_all_values(spark):
    from talweg.plans import registry

    assert "percentile" not in plan(registry.queries()["gate_results"](spark, "/root/testdata/sf0.001"))


def test_equal_names_are_compared_once(spark):
    words = ["red big box", "red big fox", "blue box", "", "", None, "red big box", "x", "red big boxes"]
    df = spark.createDataFrame([(i % 90, f"b{i % 2}" if i % 11 else None, words[i % len(words)]) for i in range(140)], "id long, b string, name string")
    old = df.select("b", F.col("id").alias("a"), F.col("name").alias("x")).join(df.select("b", F.col("id").alias("z"), F.col("name").alias("y")), "b").filter("a < z")
    for least in (0, 60, 75, 91.7, 100):
        want = old.withColumn("score", text.levenshtein_ratio(F.col("x"), F.col("y"))).filter(F.col("score") >= least).select("a", "z", "score")
        assert sorted(tuple(r) for r in identity.similar_pairs(df, "id", "name", ["b"], least).collect()) == sorted(tuple(r) for r in want.collect())
    many = spark.range(3000).select("id", F.lit("b").alias("b"), F.concat(F.lit("name "), F.col("id") % 3).alias("name"))
    got = identity.similar_pairs(many, "id", "name", ["b"], 100)
    assert got.count() == 3 * 1000 * 999 // 2
    assert "distinct" in plan(got).lower() or plan(got).count("HashAggregate") >= 4


def test_pairs_of_either_key_are_told_apart_without_a_shuffle(spark, monkeypatch):
    rows = [(i, i % 5 if i % 11 else None, float(i % 7) if i % 13 else None) for i in range(200)] + [(3, 9, 1.0), (3, 3, 3.0), (3, 3, 3.0), (4, 2, float("nan")), (5, None, float("nan")), (None, 1, 1.0), (900, 0, -0.0), (901, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, k1 long, k2 double")
    pairs = [df.select(F.col(k), F.col("id").alias("a")).dropna().join(df.select(F.col(k), F.col("id").alias("b")).dropna(), k).filter("a < b").select("a", "b") for k in ("k1", "k2")]
    want = sorted(tuple(r) for r in pairs[0].union(pairs[1]).distinct().collect())
    assert sorted(tuple(r) for r in relational.either_key_pairs(df, "id", ["k1", "k2"]).collect()) == want
    monkeypatch.setattr(relational, "SLICE_ROWS", 7, raising=False)
    got = relational.either_key_pairs(df, "id", ["k1", "k2"])
    assert sorted(tuple(r) for r in got.collect()) == want
    kind, asked = type(df), []
    real = kind.distinct
    monkeypatch.setattr(kind, "distinct", lambda self: asked.append(self.count()) or real(self))
    monkeypatch.setattr(relational, "SLICE_ROWS", 300, raising=False)
    many = relational.either_key_pairs(spark.range(1000).select("id", F.lit(1).alias("k1"), (F.col("id") % 3).alias("k2")), "id", ["k1", "k2"])
    assert max(asked) <= 1000  # never the pairs
    busy = many.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in busy) == 1000 * 999 // 2 and len(busy) > 1
