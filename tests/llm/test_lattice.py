import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as tokens
import pyarrow as pa
import pytest

from talweg.llm import lattice

PATH = tokens.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_word(v, log_p, word):
    at = {p: i for i, p in enumerate(v.pieces)}
    s = b" " + word.encode()
    alpha = [1.0] + [0.0] * len(s)
    for j in range(1, len(s) + 1):
        alpha[j] = sum(alpha[i] * math.exp(log_p[at[s[i:j]]]) for i in range(max(0, j - v.longest), j) if s[i:j] in at)
    return math.log(alpha[-1])


def brute_base(rows):
    """doc_id -> (held out, tokens, known, N, base score)."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    texts = [re.findall(r"[^\x20\x09-\x0D]+", fold(t)) + [None] for _, t in rows]
    c = Counter(w for h, t in zip(held, texts, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for (i, _), h, t in zip(rows, held, texts, strict=True)]


def check(spark, rows):
    got = lattice.score(spark.createDataFrame(rows, "doc_id long, text string, block int, key long, n int"), vocabulary_path=PATH).collect()
    want = sorted(brute_base([r[:2] for r in rows]), key=str)
    got = sorted((tuple(r) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert all(g[6] < 0 and math.isfinite(g[6]) for g in got)
    return got


def test_marginal_sums_all_segmentations():
    v = lattice.Vocabulary.load(PATH)
    log_p = np.append(np.log(v.start[:-1]), -np.inf)
    texts = ["The theory of éàü straße a x zebra 漢字", "", "of of THE internationalisation \x00"]
    parts, distinct, places = lattice._distinct(pa.array(texts))
    got = lattice.marginals(v, log_p, parts, len(distinct), places)
    for _, _, w, each in parts:
        for k, at in enumerate(each):
            word = fold(w.body[w.start[k] : w.end[k]].tobytes().decode())
            assert got[at] == pytest.approx(brute_word(v, log_p, word))


def test_expected_counts_cover_every_byte():
    v = lattice.Vocabulary.load(PATH)
    log_p = np.append(np.log(v.start[:-1]), -np.inf)
    out = np.zeros(len(log_p))
    lattice.Lattice(v, np.frombuffer(b"theory" + b"zebras", np.uint8).reshape(2, 6)).expected(log_p, np.array([2.0, 3.0]), out)
    assert sum(n * len(p) for n, p in zip(out, v.pieces, strict=False)) == pytest.approx(5 * 7)


def test_documents_match_brute_force_and_beat_words_on_held_out(spark):
    rows = [(*tuple(r), 1, 2, 3) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [g for g in check(spark, rows) if g[1]]
    assert sum(g[6] for g in got) / sum(g[2] for g in got) > -8


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "A a  a\tb"), (3, "A a  a\tb"), (4, "x" * 3000), (5, "word " * 20_000), (None, "null id"), (6, None), (7, "\n"), (8, "É é")]
    check(spark, [(*r, 0, 0, 0) for r in rows])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.score(empty, vocabulary_path=PATH).collect() == []


def test_blocks_are_bounded_however_large_a_partition(spark, monkeypatch):
    tables, real = [], lattice.written
    monkeypatch.setattr(lattice, "BLOCK_BYTES", 300, raising=False)
    monkeypatch.setattr(lattice, "written", lambda df: tables.append(real(df)) or tables[-1])
    rows = [(i, None if i % 9 == 4 else f"the {'word ' * (i % 11)}of w{i % 5} é{i}") for i in range(120)] + [(120, "long " * 200), (121, "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((tuple(r) for r in lattice.score(docs, vocabulary_path=PATH).collect()))
    want = sorted(brute_base(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    blocks = {}
    for r in tables[0].collect():
        blocks.setdefault(r["block"], []).append(len((r["text"] or "").encode()))
    assert len(blocks) > 5
    assert all(sum(sizes) - max(sizes) <= 300 for sizes in blocks.values())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a word's rows reach over batches
    try:
        again = sorted((tuple(r) for r in lattice.score(docs, vocabulary_path=PATH).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [g[:5] for g in again] == [g[:5] for g in got]
    assert [g[5:] for g in again] == [pytest.approx(g[5:]) for g in got]
