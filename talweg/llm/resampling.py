"""Quality classifier by importance resampling with hashed n-gram models.

Two bag-of-n-grams models over a fixed number of hash buckets are counted, one
for target text (documents labelled good) and one for the raw text (all
documents). A document's log weight is the sum of log ratios of its n-grams;
adding Gumbel noise and keeping the k largest samples k documents without
replacement in proportion to their weights.

The n-grams are of words (A-Z folded) and of word shapes: capitals, digits, the
closing punctuation, and whether a word repeats one shortly before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.llm.common import mapped, written
from talweg.llm.words import Words, filled, mix, slices

BUCKETS = 1 << 15
_HALF = np.uint64(BUCKETS // 2)
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_PUNCTUATION = np.zeros(256, np.uint8)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1


def _per_word(flags: np.ndarray, w: Words) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))
    return total[w.end] - total[w.start]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of a slice, five rows to a word, and each text's first word."""
    w = Words(texts)
    n = len(w.start)
    if not n:
        return np.empty((5, 0), np.int32), w.first
    h, size = w.hash, w.end - w.start
    upper, marks, digits = (_per_word(f[w.body], w) for f in (_UPPER, _PUNCTUATION, _DIGIT))
    last = w.body[w.end - 1]
    shape = np.minimum(upper, 2) + 3 * (upper + marks + digits >= size) + 6 * np.minimum(marks, 3) + 24 * np.minimum(digits, 2) + 72 * np.where(_PUNCTUATION[last] > 0, last, 0).astype(np.int64)
    nth = np.arange(n) - np.repeat(w.first[:-1], w.n)
    again = np.zeros(n, np.int64)
    for back in (1, 2, 3, 4):
        same = np.zeros(n, bool)
        same[back:] = h[back:] == h[:-back]
        again |= (same & (nth >= back)).astype(np.int64) << (back - 1)
    shape = mix((shape + 100_000 * again).astype(np.uint64) + np.uint64(1))

    def before(x: np.ndarray, back: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[back:] = x[:-back]
        out[nth < back] = np.uint64(back)  # a text's beginning
        return out

    one, two = before(shape, 1), before(shape, 2)
    out = np.empty((5, n), np.int32)
    out[0] = h % _HALF
    out[1] = mix(h + before(h, 1) * np.uint64(3)) % _HALF
    out[2] = shape % _HALF + _HALF
    out[3] = mix(shape + one * np.uint64(3)) % _HALF + _HALF
    out[4] = mix(shape + one * np.uint64(3) + two * np.uint64(7)) % _HALF + _HALF
    return out, w.first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums per text; empty texts sum to 0."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def noise(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise that depends on id and seed alone."""
    u = (mix(mix(ids.astype(np.int64).view(np.uint64)) + np.uint64(seed)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / (1 << 53)))


def fit(docs: DataFrame, good: DataFrame, *, id_col: str, text_col: str, most_labelled: int) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket.

    ``good``: ids of target documents, of which ``most_labelled`` at most (those
    with the smallest hash) are used; the raw model counts every document.
    """
    ids = good.select(F.col(id_col).cast("long").alias("id")).dropna().distinct()
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(most_labelled).collect()
    target = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["id"] for r in chosen], np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts = filled(batch.column(1))
            own = np.isin(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), target.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for at, to in slices(texts):
                f, first = features(texts.slice(at, to - at))
                counts[0] += np.bincount(f.ravel(), minlength=BUCKETS)
                words = np.repeat(own[at:to], np.diff(first))
                counts[1] += np.bincount(f[:, words].ravel(), minlength=BUCKETS)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(c[some]) for c in counts)], names=["bucket", "raw", "target"])

    counted = mapped(docs.select(F.col(id_col).cast("long"), text_col), count, "bucket int, raw long, target long")
    raw, aimed = np.ones(BUCKETS), np.ones(BUCKETS)  # add-one smoothing
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BUCKETS rows at most
        raw[r["bucket"]] += r["raw"]
        aimed[r["bucket"]] += r["target"]
    return np.log(aimed / aimed.sum()) - np.log(raw / raw.sum())


def scored(docs: DataFrame, ratio: np.ndarray, *, id_col: str, text_col: str, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, log_weight, noisy, place) and the columns ``keep`` in a struct ``doc``; ``place`` orders as ``noisy`` does, as a long."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc") if keep else F.lit(0).alias("doc"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("noisy", T.DoubleType()), T.StructField("place", T.LongType()), rows.schema["doc"]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1))
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            for at, to in slices(texts):
                f, first = features(texts.slice(at, to - at))
                weight = _sums(shared.value[f].sum(0), first)
                noisy = weight + noise(ids[at:to], seed)
                bits = noisy.view(np.int64)
                place = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(weight), pa.array(noisy), pa.array(place), batch.column(2).slice(at, to - at)], names=schema.names)

    return mapped(rows, score, schema)


def best_cut(weights: list[float], good: list[bool]) -> float:
    """The middle of the gap that separates good from other rows with the best mean accuracy of both; -inf unless both occur."""
    order = np.argsort(np.array(weights), kind="stable")
    w, g = np.array(weights)[order], np.array(good, bool)[order]
    if not len(w) or g.all() or not g.any():
        return -math.inf
    below_bad, above_good = np.cumsum(~g) / (~g).sum(), 1 - np.cumsum(g) / g.sum()
    gain = np.where(np.append(w[1:] > w[:-1], True), below_bad + above_good, -1.0)
    i = int(np.argmax(gain))
    return float((w[i] + w[i + 1]) / 2) if i + 1 < len(w) else math.inf


def kth_largest(rows: DataFrame, place: Column, k: int) -> int | None:
    """The k-th largest of a long column, digit by digit: four counts of at most 65,536 groups each.

    None where there are fewer than k rows or k is 0.
    """
    if k <= 0:
        return None
    digits: list[int] = []
    x = rows.select((place.bitwiseXOR(F.lit(-(1 << 63)))).alias("x"))  # unsigned order
    for level in range(4):
        digit = F.shiftrightunsigned("x", 48 - 16 * level).bitwiseAND(0xFFFF)
        some = x
        for i, d in enumerate(digits):
            some = some.filter(F.shiftrightunsigned("x", 48 - 16 * i).bitwiseAND(0xFFFF) == d)
        for r in sorted(some.groupBy(digit.alias("d")).count().collect(), key=lambda r: -r["d"]):
            if r["count"] >= k:
                digits.append(r["d"])
                break
            k -= r["count"]
        else:
            return None
    value = 0
    for d in digits:
        value = value << 16 | d
    return value - (1 << 63)


def resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    share: float | None = None,
    most_labelled: int = 20_000,
    seed: int = 20240229,
    columns: bool = False,
) -> DataFrame:
    """The sampled rows of ``docs``: id, log_weight and noisy (log weight plus noise), or with ``columns`` the rows of ``docs`` themselves.

    ``share`` of all rows is kept, by default the share whose weight is above
    the value that best tells labelled rows apart (all, where not both labels
    occur). Only what is fitted is bounded: ``most_labelled`` target documents,
    and as many labelled rows for that value; the raw model, all scores and the
    cut cover every row. Rows that
    tie with the last one kept are kept too, so repeated rows stay or go
    together. Null and empty texts have weight 0 and so go by their noise, as
    do all rows where nothing is labelled 1; null ids share one noise value;
    null labels count as no label; without labels every row is kept; an empty
    table gives no rows. Columns of any name may come along.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    good = known.filter(F.col(label_col) == 1)
    ratio = np.zeros(BUCKETS) if good.isEmpty() else fit(docs, good, id_col=id_col, text_col=text_col, most_labelled=most_labelled)
    scores = written(scored(docs, ratio, id_col=id_col, text_col=text_col, seed=seed).drop("doc"))
    if share is None:
        told = known.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) == 1).alias("good"))
        some = scores.join(told, "id").orderBy(F.xxhash64("id"), "id").limit(most_labelled).select("log_weight", "good").collect()
        k = scores.filter(F.col("log_weight") >= best_cut([r["log_weight"] for r in some], [r["good"] for r in some])).count()
    else:
        k = math.floor(share * scores.count() + 0.5)
    least = kth_largest(scores, F.col("place"), k)
    kept = F.lit(k > 0) if least is None else F.col("place") >= least
    if not columns:
        return scores.filter(kept).select("id", "log_weight", "noisy")
    names = tuple(docs.columns)
    whole = scored(docs, ratio, id_col=id_col, text_col=text_col, seed=seed, keep=names).filter(kept)
    return whole.select(*[F.col("doc").getField(c).alias(c) for c in names])
