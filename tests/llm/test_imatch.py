import hashlib
import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from talweg.llm import imatch

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(id, n_chars, sha256 of the edited text) of each row."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1].encode()), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, print string, bucket int")
    return imatch.fingerprints(df, **options).collect()


def test_edited_texts_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, rows, rows_per_bucket=7)
    assert sorted(((r["id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == brute(rows)
    by_text = {}
    texts = dict(rows)
    for r in got:
        assert by_text.setdefault(texts[r["id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for r in got if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.8


def test_edge_cases(spark):
    rows = [(3, None), (3, ""), (7, "a"), (9, "ab cd é漢🙂 " * 3), (9, "ab cd é漢🙂 " * 3), (9, "zz"), (None, "no id here"), (100, "w " * 30_000), (-5, "A b, c."), (1 << 40, "same same")]
    got = run(spark, rows, rows_per_bucket=2, least_df=1, idf_low=0.0)
    assert sorted(((r["id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == brute(rows)
    assert all(r["near_edited"] is not None and r["near_next"] is not None for r in got)
    (only,) = run(spark, [(1, "alone here")])
    assert only["n_chars"] == 10 and only["near_next"] == 1.0
    assert only["edited_sha256"] == hashlib.sha256(b"alonealone").hexdigest()
    assert run(spark, []) == []


def test_band_and_order_of_terms(spark):
    rows = [(i, f"common word{i % 5} once{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string")
    cells = imatch.lexicon(df, "text", 1.0, 2)
    assert sum(bin(c & (1 << 64) - 1).count("1") for c in cells) == 5  # word0 to word4 alone are in the band
    same = df.limit(1).select(imatch.slots(F.lit("word1 word2, WORD1 once99"), cells).alias("a"), imatch.slots(F.lit("Word2 other word1"), cells).alias("b")).first()
    assert same["a"] == same["b"]


def hash64(*values, seed=42):
    """Hash of values in turn: texts as their bytes, numbers as four or eight bytes."""
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


def plain_print(text, lexicon):
    """A fingerprint by plain loops over words."""
    found = sorted({t for w in re.split(r"[\x00-/:-`{-\x7F]+", text.lower()) if w and (t := hash64(w) & ((1 << imatch.BITS) - 1)) in lexicon})
    short = lambda terms: f"{hash64(*terms) & 0xFFFFFFFF:08x}"
    slots = [[] for _ in range(imatch.LEVELS * imatch.SLOTS)]
    for t in found:
        u = hash64(t, "subset") & ((1 << 30) - 1)
        low = 0
        for level in range(imatch.LEVELS):
            width = (1 << 30) // (imatch.FIRST_RATE * 4**level)
            if low <= u < low + imatch.SLOTS * width:
                slots[level * imatch.SLOTS + (u - low) // width].append(t)
            low += imatch.SLOTS * width
    whole = short(found) if found else "t" + hashlib.sha256(text.encode()).hexdigest()[:16]
    return [whole, *(short(s) if s else "" for s in slots)]


def test_fingerprints_match_plain_loops(spark):
    rows = [(r[0], r[1] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    df = Counter(t for _, text in rows for t in {hash64(w) & ((1 << imatch.BITS) - 1) for w in re.split(r"[\x00-/:-`{-\x7F]+", text.lower()) if w})
    lexicon = {t for t, n in df.items() if 2 <= n <= len(rows) / math.exp(1.5)}
    order = sorted(rows, key=lambda r: (r[0], r[1].encode()), reverse=True)
    prints = [plain_print(t, lexicon) for _, t in order]

    def like(a, b):
        pairs = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in pairs) / len(pairs)

    want = {}
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        edited = plain_print(t[: len(t) - half] + order[(k + 1) % len(order)][1][:half], lexicon)
        want[i] = ("-".join(prints[k]), "-".join(edited), like(prints[k], edited), like(prints[k], prints[(k + 1) % len(order)]))
    got = {r["id"]: (r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in run(spark, rows)}
    assert got == want
