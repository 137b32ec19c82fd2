import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.llm import topk


def brute(rows, k=5, every=50):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in fine if i % every == 0}):
        scores = sorted(((sum(a * b for a, b in zip(q, v)), j) for h, q in fine if h == i for j, v in fine if j != i), key=lambda s: (-s[0], s[1]))[:k]
        out += [(i, n + 1, j, s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, every=50, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, norm int, place string")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, **options).collect())


@pytest.mark.parametrize("options", [{}, {"block_rows": 60, "query_rows": 4}, {"block_rows": 30, "query_rows": 100, "lengths": 3}])
def test_matches_brute_force(spark, options):
    r = np.random.default_rng(4)
    v = r.normal(size=(400, 12)) * r.lognormal(size=(400, 1))
    v[100:140] = v[7]  # ties
    rows = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]
    assert found(spark, rows, every=20, **options) == brute(rows, every=20)


def test_edge_cases(spark):
    rows = [(0, [0.5, 0.5]), (50, [0.0, 0.0]), (1, [1.0, -1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, []), (8, [0.25, 0.5]), (8, [0.25, 0.5])]
    got = found(spark, rows, block_rows=2, query_rows=1)
    assert got == brute([(i, v if v is None else v + [0.0] * (2 - len(v))) for i, v in rows])
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0])]) == []
    assert found(spark, [(0, [1.0])]) == []


def test_repeated_ids_are_candidates_of_their_own(spark):
    rows = [(1, [3.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (50, [1.0, 0.0]), (50, [0.0, 2.0]), (3, [0.0, 9.0])] + [(4, [0.5, 0.5])] * 3
    got = found(spark, rows, block_rows=2, query_rows=1)
    assert got == brute(rows) and got[1][2:] == (1, 196608)


def test_buckets_of_very_different_lengths_match_brute_force(spark):
    r = np.random.default_rng(3)
    unit = r.normal(size=(600, 8))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    rows = [(i, [float(np.float32(x)) for x in v * (50 if i < 300 else 0.5)]) for i, v in enumerate(unit)]
    assert found(spark, rows, block_rows=50, query_rows=4) == brute(rows)


def test_bounds_only_drop_what_falls_short():
    r = np.random.default_rng(8)
    v, q = np.floor(r.normal(size=(300, 16)) * 100), np.floor(r.normal(size=(20, 16)) * 100)
    for level in (0.2, 0.7, 0.9, 1.5):
        least = level * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
        got = topk.search_block(np.arange(1000, 1020), q, least, np.arange(300), v, 5)
        want = []
        for i in range(20):
            s = v @ q[i]
            order = [j for j in np.lexsort((np.arange(300), -s)) if s[j] >= least[i]][:5]
            want += [(1000 + i, int(j), float(s[j])) for j in order]
        assert sorted(got) == sorted(want)
