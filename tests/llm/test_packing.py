import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokens
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from talweg.llm import packing
from talweg.llm.bpe import encoder

PATH, RANKS = tokens.path("byte_bpe_50k.json"), tokens.path("byte_bpe_50k.tiktoken")
ODD = ["", "  ", "a  b", "x  y  z", "a\n\nb \n c", "<|endoftext|> a <|endoftext|>b", "don't  'll x 12 3.4\t\tq\r\n", "é ü 漢字 🙂 x", "\x1c a\x1d b", " lead", "trail  ", "a \x85b", "z" * 5000, "x,y.z, .w a., b,. \n,c d\n\ne.f", "a.<|endoftext|>,b\n<|endoftext|>", "a\xa0b c.\xa0d", "1,000.5, a1,b2."]


def test_ids_equal_the_tokenizers():
    exact = Tokenizer.from_file(PATH)
    for path, ranks in ((PATH, RANKS), (PATH, None)):
        at = 0
        for first, ids, off in encoder(path, ranks).slices(pa.array(ODD)):
            for i in range(len(off) - 1):
                assert ids[off[i] : off[i + 1]].tolist() == exact.encode(ODD[first + i], add_special_tokens=False).ids
                at += 1
        assert at == len(ODD)


def test_strategy_places_every_piece_once():
    r = np.random.default_rng(0)
    for n, top in ((5000, 64), (300, 64), (1, 64), (20_000, 200)):
        lengths = r.integers(1, top + 1, n)
        histogram = np.bincount(lengths, minlength=top + 1)
        plan = packing.strategy(histogram, top)
        used = Counter()
        for content, times in plan:
            assert sum(content) <= top and times > 0
            for v in content:
                used[v] += times
        assert used == Counter(lengths.tolist())
        assert sum(t for _, t in plan) <= -(-int(lengths.sum()) // top) * 1.01 + 2
    assert packing.strategy(np.zeros(65, np.int64), 64) == []


def test_fit_is_non_negative_and_close():
    r = np.random.default_rng(1)
    columns = packing.patterns(32, 3, np.ones(33, bool))
    truth = r.integers(0, 50, len(columns)) * (r.random(len(columns)) < 0.1)
    histogram = np.zeros(33)
    for c, n in zip(columns, truth, strict=True):
        for v in c[c > 0]:
            histogram[v] += n
    x = packing.fit(columns, histogram, 3000)
    got = np.zeros(33)
    np.add.at(got, columns.ravel(), np.repeat(x, 3))
    assert (x >= 0).all()
    assert got[1:] == pytest.approx(histogram[1:], abs=histogram.max() * 0.02)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "word " * 3000)] + list(enumerate(ODD, 10))
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, part int, rank int")
    got = packing.pack(df, tokenizer_path=PATH, ranks_path=RANKS, with_ids=True).collect()
    exact = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 1024 + 1
        for k, a in enumerate([0, *range(head, len(ids), 1024)]):
            piece = ids[a : a + (head if k == 0 else 1024)]
            want[(i, k, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), tuple(piece))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    seats = defaultdict(list)
    for r in got:
        seats[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seats.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1]) and sum(n for _, n in s) <= 1024
    assert packing.pack(df.limit(0), tokenizer_path=PATH, ranks_path=RANKS).count() == 0
