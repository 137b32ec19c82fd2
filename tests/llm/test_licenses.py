import re

from pyspark.sql import functions as F

from talweg.llm import licenses
from talweg.llm.queries import op6_diagonal_license_scan

SF = "/root/testdata/sf0.001"
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_base_counts_match_brute_force(spark):
    got = {r["doc_id"]: r for r in op6_diagonal_license_scan(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(d["text"])
        assert {*r["base_labels"].split(",")} <= {*r["labels"].split(","), ""}
        assert 0 <= r["score"] <= 1


def spans(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, grams int, mark int")
    return [(r["id"], r["n_words"], [(s["label"], s["first_word"], s["last_word"]) for s in r["spans"]]) for r in licenses.scan(df).orderBy(F.col("id").asc_nulls_first(), "n_words").collect()]


def test_edge_cases(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        (1, None), (2, ""), (3, "CC-BY cc by"), (3, "CC-BY cc by"), (4, "cc"), (5, "é" * 10), (6, "x " * 30_000 + "All Rights Reserved."),
        (7, "start " + mit.replace("hereby granted", "hereby now granted").replace(" any", "") + " end"), (8, "permission is granted to any person"), (None, "general public license"),
    ]
    got = spans(spark, [(*r, "x", 1, 2) for r in rows])
    assert [g for g in got if g[0] in (1, 2, 4, 8)] == [(1, 0, []), (2, 0, []), (4, 1, []), (8, 6, [])]
    assert [g for g in got if g[0] == 3] == [(3, 4, [("cc-by", 0, 1), ("cc-by", 2, 3)])] * 2
    assert [g for g in got if g[0] == 6] == [(6, 30_003, [("reserved", 30_000, 30_002)])]
    assert [g for g in got if g[0] is None] == [(None, 3, [("gpl", 0, 2)])]
    (_, n, found), = [g for g in got if g[0] == 7]
    assert [s[0] for s in found] == ["mit"] and found[0][1] == 1 and found[0][2] == n - 2
    assert spans(spark, []) == []


def test_longest_chain():
    assert licenses.longest_chain([(5, 0), (6, 1), (9, 2), (1, 9)]) == (3, 5, 9)
    assert licenses.longest_chain([(5, 0), (5, 1)])[0] == 1


def plain_spans(text):
    """(label, coverage) of each verified notice, by comparing words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for label, notices in licenses.NOTICES.items():
        for notice in notices:
            want = re.findall(r"[a-z0-9]+", notice.lower())
            indexed = [i for i in range(len(want) - 1) if not {*want[i : i + 2]} <= licenses.COMMON]
            hits = [(p, i) for i in indexed for p in range(len(words) - 1) if words[p : p + 2] == want[i : i + 2]]
            runs = []
            for d in sorted({p - i for p, i in hits}):
                if runs and d - runs[-1][-1] <= 3:
                    runs[-1].append(d)
                else:
                    runs.append([d])
            for run in runs:
                some = sorted(h for h in hits if h[0] - h[1] in run)
                if len({i for _, i in some}) < 0.75 * len(indexed):
                    continue
                n, first, last = licenses.longest_chain(some)
                if n >= 0.75 * len(indexed) and last - first < 2 * (len(indexed) + 2):
                    out.append((label, n / len(indexed)))
    return out


def test_labels_and_scores_match_plain_comparison(spark):
    got = {r["doc_id"]: r for r in op6_diagonal_license_scan(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = brute(d["text"])
        found = plain_spans(d["text"])
        labels = {x for x, _ in found} | {*base[4].split(",")} - {""}
        assert got[d["doc_id"]]["labels"] == ",".join(sorted(labels))
        assert got[d["doc_id"]]["score"] == max([c for _, c in found] + [1.0] * bool(base[1]), default=0.0)
