"""Queries over whole tables, against brute force."""

import re
from collections import defaultdict
from random import Random

from talweg.operators import graph
from talweg.plans import registry

SF = "/root/testdata/sf0.001"


def union_find(edges):
    """The smallest node of each node's component."""
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {x: top(x) for x in list(root)}


def test_mention_groups_of_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderkey", "o_custkey % 400", "floor(o_totalprice * 100) % 100000").collect()
    of = union_find([(o, k) for o, c, d in orders for k in ((1 << 60) + c, (1 << 61) + d)])
    got = {tuple(r) for r in registry.queries()["mention_groups"](spark, SF).collect()}
    assert got == {(o, of[o]) for o, _, _ in orders}


def opponents(spark):
    by_order = defaultdict(set)
    for o, s in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect():
        by_order[o].add(s)
    return {(a, b) for x in by_order.values() for a in x for b in x if a < b}


def bridges_of(edges):
    return {e for e in edges if (of := union_find([x for x in edges if x != e] + [(v, v) for v in e]))[e[0]] != of[e[1]]}


def test_graph_of_all_lineitems(spark):
    edges = opponents(spark)
    assert {tuple(r) for r in registry.queries()["connected_components"](spark, SF).collect()} == set(union_find(edges).items())
    found = bridges_of(edges)
    assert sorted(tuple(r) for r in registry.queries()["bridge_edges"](spark, SF).collect()) == sorted((*e, e in found) for e in edges)


def test_blocks_keep_bridges(spark):
    r = Random(3)
    edges = {(min(a, b), max(a, b)) for _ in range(70) if (a := r.randrange(60)) != (b := r.randrange(60))} | {(a, b) for a in range(100, 115) for b in range(a + 1, 115)} | {(5, 100), (114, 200)}
    got = graph.bridges(spark.createDataFrame(sorted(edges), "a long, b long"), block=20)
    assert {tuple(x) for x in got.collect()} == bridges_of(edges)
    dense = [(a, b) for a in range(40) for b in range(a)]
    assert len(graph._certificate(dense)) <= 78


def test_draws_of_all_events(spark):
    got = registry.queries()["conditional_draws"](spark, SF)
    want = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert got.count() == 4 * want.count()
    assert got.select("l_orderkey").distinct().count() == want.select("l_orderkey").distinct().count()


def number(value):
    found = value is not None and re.search(r"(\d+(?:,\d{3})*(?:\.\d+)?)(?:\s*(hundred|thousand|million|billion)\b)?", value, re.I | re.A)
    return float(found[1].replace(",", "")) * {"hundred": 1e2, "thousand": 1e3, "million": 1e6, "billion": 1e9}.get((found[2] or "").lower(), 1.0) if found else None


def items(value):
    return None if value is None else sum(x.strip(" ") != "" for x in re.split(r"(?i:<br\s*/?>)|[\n•*]+", value))


def test_numbers_and_items_of_all_documents(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10**6 + i, t) for i, t in enumerate((None, "", "In 1805, 3 thousand men", "2.5 Million", "1,200 hundred", "a • b * c<br/>d\n\n", "* <BR> x", "7 millions"))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name: dict(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert got("parse_numbers") == {i: number(t) for i, t in docs}
    assert got("list_items") == {i: items(t) for i, t in docs}


def test_circles_of_any_length(spark):
    rows = [("long", i, (i + 1) % 50) for i in range(50)] + [("chain", i, i + 1) for i in range(70)] + [("tail", 0, 1), ("tail", 1, 2), ("tail", 2, 1)]
    got = graph.has_cycle(spark.createDataFrame(rows, "side string, n int, p int"), ["side"], "n", "p")
    assert {r[0] for r in got.collect()} == {"long", "tail"}
