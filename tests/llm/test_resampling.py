import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talweg.llm import resampling
from talweg.llm.words import Words, mix

SF = "/root/testdata/sf0.01"


def test_separates_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    kept = {r["id"] for r in resampling.resample(docs, labels.filter(~held)).collect()}
    unseen = labels.filter(held).collect()
    good = [r["doc_id"] in kept for r in unseen if r["quality"] == 1]
    bad = [r["doc_id"] in kept for r in unseen if r["quality"] == 0]
    assert np.mean(good) > 0.97
    assert np.mean(bad) < 0.1


def test_kth_largest_is_exact(spark):
    r = np.random.default_rng(1)
    x = [int(v) for v in np.concatenate([r.integers(-(2**62), 2**62, 300), r.integers(-5, 5, 100), [-(2**63), 2**63 - 1]])]
    df = spark.createDataFrame([(v,) for v in x], "v long")
    for k in (1, 2, 7, 200, 402):
        assert resampling.kth_largest(df, F.col("v"), k) == sorted(x, reverse=True)[k - 1]
    assert resampling.kth_largest(df, F.col("v"), 0) is None
    assert resampling.kth_largest(df, F.col("v"), 403) is None


def test_gumbel_top_k_samples_by_weight():
    """With two weights, the chance to win against each other follows their ratio."""
    a, b = resampling.noise(np.arange(40_000), 1), resampling.noise(np.arange(40_000, 80_000), 1)
    assert np.mean(a + np.log(3) > b) == pytest.approx(0.75, abs=0.01)


def test_features_match_by_text():
    import pyarrow as pa

    texts = ["One two, two THREE 44.", "", "x", "x x x x", "One two, two THREE 44."]
    whole, first = resampling.features(pa.array(texts))
    for i, t in enumerate(texts):
        alone, _ = resampling.features(pa.array([t]))
        assert (whole[:, first[i] : first[i + 1]] == alone).all()


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "w " * 50_000, "c"), (4, "good text here", "d"), (4, "good text here", "d"), (None, "bad ###", "e"), (5, "BAD ###", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (3, None), (None, 1)], "doc_id long, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert resampling.resample(docs, none).count() == len(rows)
    assert resampling.resample(docs, labels, share=1.0).count() == len(rows)
    assert resampling.resample(docs, labels, share=0.0).count() == 0
    kept = resampling.resample(docs, labels, columns=True)
    assert kept.columns == docs.columns
    assert 4 in {r["doc_id"] for r in kept.collect()} and 5 not in {r["doc_id"] for r in kept.collect()}
    assert resampling.resample(docs.limit(0), labels).count() == 0
    assert resampling.resample(docs.limit(0), labels, columns=True).count() == 0


def plain_features(text):
    """Buckets of a text's n-grams, word by word."""
    half = resampling.BUCKETS // 2
    m = (1 << 64) - 1
    mixed = lambda x: int(mix(np.array([x & m], np.uint64))[0])
    raw = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words, shapes, out = [], [], []
    for i, w in enumerate(raw):
        h = int(Words(pa.array([w.decode()])).hash[0])
        upper, digits = sum(65 <= b <= 90 for b in w), sum(48 <= b <= 57 for b in w)
        marks = sum(33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in w)
        last = w[-1] if 33 <= w[-1] < 48 or 58 <= w[-1] < 65 or 91 <= w[-1] < 97 or 123 <= w[-1] < 127 else 0
        again = sum(1 << (k - 1) for k in (1, 2, 3, 4) if i >= k and words[i - k] == h)
        shape = mixed(min(upper, 2) + 3 * (upper + marks + digits >= len(w)) + 6 * min(marks, 3) + 24 * min(digits, 2) + 72 * last + 100_000 * again + 1)
        before = lambda x, k: x[i - k] if i >= k else k  # noqa: B023, E731
        words.append(h)
        shapes.append(shape)
        out += [h % half, mixed(h + before(words, 1) * 3) % half, shape % half + half, mixed(shape + before(shapes, 1) * 3) % half + half, mixed(shape + before(shapes, 1) * 3 + before(shapes, 2) * 7) % half + half]
    return out


def test_scores_and_rows_match_plain_recomputation(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r[1] or "") < 4000]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    grams = {i: plain_features(t) for i, t in rows}
    raw, good = [1] * resampling.BUCKETS, [1] * resampling.BUCKETS
    for i, g in grams.items():
        for b in g:
            raw[b] += 1
            good[b] += quality.get(i) == 1
    weight = {i: sum(math.log(good[b] / sum(good)) - math.log(raw[b] / sum(raw)) for b in {*g} for _ in range(g.count(b))) if g else 0.0 for i, g in grams.items() if len(g) < 400}
    got = {r["id"]: r for r in resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, share=1.0).collect()}
    assert set(got) == set(grams)
    for i, w in weight.items():
        assert got[i]["log_weight"] == pytest.approx(w, abs=1e-6)
        assert got[i]["noisy"] == pytest.approx(got[i]["log_weight"] + resampling.noise(np.array([i]), 20240229)[0])
    for share in (0.3, 0.75):
        kept = {r["id"] for r in resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, share=share).collect()}
        assert kept == {*sorted(got, key=lambda i: -got[i]["noisy"])[: math.floor(share * len(rows) + 0.5)]}
