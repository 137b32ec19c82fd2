import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.llm import mixing
from talweg.llm.queries import OP8_SQL, op8_curriculum_mixing

SF = "/root/testdata/sf0.001"


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(OP8_SQL).fetchall())
    got = [tuple(r) for r in op8_curriculum_mixing(spark, SF).collect()]
    assert sorted(got) == want
    places = [(r[5] is None, r[5] or 0, r[0]) for r in got]
    assert places == sorted(places) and any(r[6] for r in got)
    assert got == [tuple(r) for r in op8_curriculum_mixing(spark, SF).collect()]


def test_reruns_give_the_same_order(spark):
    rows = [(i % 7, f"{'w ' * (i % 5)}", "abc"[i % 3]) for i in range(120)] + [(None, "x", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = [tuple(r) for r in mixing.mixed(mixing.mix_plan(df)).collect()]
    assert first == [tuple(r) for r in mixing.mixed(mixing.mix_plan(df.repartition(5))).collect()]


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 450, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.water_fill([10, 1000], [5, 1], 1515, 2) == pytest.approx([20, 1495])
    assert mixing.water_fill([0, 0], [1, 1], 0, 2) == [0, 0]
    assert mixing.water_fill([], [], 0, 2) == []
    assert sum(mixing.water_fill([5, 6, 7, 8], [5, 2, 1, 5], 39, 2)) == pytest.approx(39)


@pytest.mark.parametrize("schedule", mixing.DEFAULT_SCHEDULES + (((0.0, 0.0), (0.5, 1.0), (1.0, 0.0)), ((0.0, 1.0), (0.3, 0.0), (0.6, 0.0), (1.0, 2.0))))
def test_positions_invert_the_integral(spark, schedule):
    pieces = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("t0", "t1", "w0", "w1", "c0", "c1"), p, strict=True)]) for p in mixing.segments(schedule)])
    shares = [i / 40 for i in range(40)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.invert(pieces, F.col("s"))).collect()]
    t = np.linspace(0, 1, 200_001)
    w = np.interp(t, [k for k, _ in schedule], [v for _, v in schedule])
    total = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2)))
    assert np.interp(got, t, total / total[-1]) == pytest.approx(shares, abs=1e-6)


def test_mix_follows_targets_and_time(spark):
    plan = mixing.mix_plan(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")).cache()
    per = plan.groupBy("doc.source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["largest"] for r in per)
    where = {r["source"]: r["p"] for r in plan.select("doc.source", "size", F.explode("positions").alias("p")).groupBy("source").agg((F.sum(F.col("p") * F.col("size")) / F.sum("size")).alias("p")).collect()}
    names = sorted(where, key=str.encode)
    early, late = (np.mean([where[n] for i, n in enumerate(names) if i % 3 == k]) for k in (0, 2))
    assert early < 0.5 < late
    mixed = mixing.mixed(plan)
    assert mixed.columns == ["doc_id", "text", "source"] and mixed.count() == plan.agg(F.sum("copies")).first()[0]


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "w " * 100, None), (3, "w " * 100, None), (4, "x y", "É"), (None, "one", "a"), (5, "w " * 60_000, "b")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    got = mixing.mix_plan(df).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["copies"] <= 2 for r in got)
    assert sorted(r["size"] for r in got) == [0, 0, 1, 2, 100, 100, 60_000]
    assert mixing.mixed(mixing.mix_plan(df)).columns == df.columns
    assert mixing.mix_plan(df.limit(0)).count() == 0
    assert mixing.mixed(mixing.mix_plan(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        mixing.segments(((0.0, 1.0), (0.5, 1.0)))
