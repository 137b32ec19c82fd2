import re
from collections import defaultdict
from random import Random

import numpy as np
from pyspark.sql import functions as F

from talweg.llm import suffixes

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least=50, only_later=False):
    """Ranges covered by runs of ``least`` words that stand in another document too (with a smaller id)."""
    where = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - least + 1):
            where[tuple(w[p : p + least])].add(i)
    out = []
    for i, t in rows:
        w, covered = words(t), set()
        for p in range(len(w) - least + 1):
            others = where[tuple(w[p : p + least])]
            if (min(others) < i) if only_later else len(others) > 1:
                covered |= {*range(p, p + least)}
        at = sorted(covered)
        starts = [x for x in at if x - 1 not in covered]
        out += [(i, s, next(x for x in range(s, len(w) + 1) if x not in covered)) for s in starts]
    return sorted(out)


def planted(seed=5):
    r = Random(seed)
    word = lambda: f"w{r.randrange(10**7)}"
    common = [[word() for _ in range(n)] for n in (50, 51, 75, 300, 49, 20)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(0, 4)):
            w += [word() for _ in range(r.choice((0, 3, 100)))] + common[r.randrange(len(common))]
        rows.append((i, " ".join(w)))
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, pos int, key string")
    return sorted(tuple(r) for r in suffixes.repeated(df, **options).collect())


def test_planted_passages_match_brute_force(spark):
    rows = planted()
    assert found(spark, rows) == brute(rows)


def test_documents_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_passages_in_changing_company_match_brute_force(spark):
    """Passages within passages, so that a suffix's best partner isn't its neighbour."""
    r = Random(11)
    rows = []
    for i, t in planted(3):
        w = t.split()
        for _ in range(2):
            p = planted(3)[r.randrange(60)][1].split()
            w[(at := r.randrange(len(w) + 1)) : at] = p[: r.randrange(10, 120)]
        rows.append((i, " ".join(w)))
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, only_later=True) == brute(rows, only_later=True)


def test_taking_later_ranges_away_leaves_one_copy(spark):
    rows = planted(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    ranges = suffixes.repeated(df, only_later=True)
    left = suffixes.without(df, ranges, chars_col="n_chars").collect()
    assert all(r["n_chars"] == len(r["text"]) for r in left)
    after = [(r["doc_id"], r["text"]) for r in left]
    assert brute(after) == []
    grams = lambda rows: {tuple(w[p : p + 20]) for _, t in rows for w in [words(t)] for p in range(len(w) - 19)}
    kept = grams(after)
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    assert all(any(g[a : a + 20] in kept for a in range(31)) for g in first)


def test_edge_cases(spark):
    same = " ".join(f"x{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "z " * 3000), (5, same), (6, same.upper()), (6, same), (7, "é " * 100), (8, "é\n" * 100), (9, " ".join(f"y{i}" for i in range(49))), (10, " ".join(f"y{i}" for i in range(49)))]
    got = found(spark, rows + [(None, same)])
    assert [g for g in got if g[0] < 7] == [(5, 0, 60), (6, 0, 60)]
    assert [g for g in got if g[0] > 6] == [(7, 0, 100), (8, 0, 100)]
    assert found(spark, []) == []
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = suffixes.without(df, spark.createDataFrame([(5, 0, 60), (9, 1, 3)], "id long, start int, end int")).collect()
    assert {r["doc_id"] for r in left} == {1, 2, 3, 4, 6, 7, 8, 9, 10}
    assert next(r["text"] for r in left if r["doc_id"] == 9).split()[:2] == ["y0", "y3"]


def test_minimisers_cover_every_window():
    r = np.random.default_rng(2)
    g = r.integers(1, 2**63, 500).astype(np.uint64)
    first = np.array([0, 20, 20, 60, 91, 123, 500])
    got = set(suffixes.minimisers(g, first, 32).tolist())
    want = set()
    for a, b in zip(first[:-1], first[1:]):
        for i in range(a, b - 31):
            want.add(i + int(np.argmin(g[i : i + 32])))
    assert got == want


def test_copies_that_go_on_differently_match_brute_force(spark):
    """A frequent passage's suffixes are dealt over all tasks by the private words that follow."""
    r = Random(4)
    word = lambda: f"w{r.randrange(10**7)}"
    line = [word() for _ in range(50)]
    rows = [(i, " ".join([word() for _ in range(40)] + line + [word() for _ in range(60)])) for i in range(400)]
    for least in (False, True):
        assert found(spark, rows, only_later=least) == brute(rows, only_later=least)


def test_private_words_beside_a_frequent_line_match_brute_force(spark):
    """Pairs share 50 words of which the line is a part, and go on differently."""
    for seed in range(3):
        r = Random(seed)
        word = lambda: f"w{r.randrange(10**7)}"  # noqa: B023, E731
        line = [word() for _ in range(30)]
        rows = []
        for i in range(0, 300, 2):
            own = [word() for _ in range(20)]
            rows += [(j, " ".join([word() for _ in range(30)] + own + line + [word() for _ in range(60)])) for j in (i, i + 1)]
        assert found(spark, rows) == brute(rows)
        assert found(spark, rows, only_later=True) == brute(rows, only_later=True)


def repeating(seed=6):
    """Texts that say a word or a phrase over and over, in other lengths and company."""
    r = Random(seed)
    word = lambda: f"w{r.randrange(10**7)}"
    phrases = [[word()], [word(), word()], [word() for _ in range(7)], [word() for _ in range(31)], [word() for _ in range(45)]]
    rows = []
    for i in range(40):
        w = []
        for _ in range(r.randrange(1, 4)):
            p = r.choice(phrases)
            w += [word() for _ in range(r.choice((0, 2, 30)))] + (p * 400)[r.randrange(len(p)) :][: r.choice((20, 49, 50, 51, 130, 700))]
        rows.append((i, " ".join(w)))
    return rows


def test_texts_that_repeat_themselves_match_brute_force(spark):
    rows = repeating()
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, only_later=True) == brute(rows, only_later=True)


def test_repeats_of_a_word_are_one_suffix(spark):
    df = spark.createDataFrame([(i, "again " * 5000) for i in range(20)], "id long, text string")
    chains = suffixes.shared_suffixes(df, suffixes.K, suffixes.W, 50)
    assert chains.count() == 20
    assert suffixes.contexts(df, chains, suffixes.K, 50).count() <= 20 * 90


def test_partition_numbers_do_not_matter(spark):
    rows = planted(12) + [(100 + i, t) for i, t in repeating(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
