"""Components, bridges, cycles and merge rules of graphs given as edge tables."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that ``spark.checkpoint.dir`` names; where that is unset, in a temporary one if all runs on one machine."""
    context = df.sparkSession.sparkContext
    if not (context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()):
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "talweg"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node's component, named by its smallest node, from edges (a, b).

    Every round maps nodes to their smallest neighbour and contracts the graph,
    until no edge is left. Loops count as nodes; an empty table has none.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropna().distinct()
    found = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    live = checkpointed(ends.filter("a <> b"))
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        moved = live.join(to, "a").select(F.col("to").alias("a"), "b").join(to.withColumnRenamed("a", "b"), "b").select(F.least("a", "to").alias("a"), F.greatest("a", "to").alias("b"))
        live = checkpointed(moved.filter("a <> b").distinct())
        found = checkpointed(found.join(to.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    return found


def _bridges(nodes: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Edges whose loss disconnects their ends: low links by an explicit stack."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    out = []
    for start in sorted(nodes):
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack = [(start, None, iter(nodes[start]))]
        while stack:
            node, parent, rest = stack[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append((to, node, iter(nodes[to])))
                    break
                if to != parent:
                    low[node] = min(low[node], index[to])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if low[node] > index[parent]:
                        out.append((min(parent, node), max(parent, node)))
    return out


def _forest(ends: list[tuple[int, int]]) -> list[bool]:
    """Whether each edge is one of a spanning forest."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    taken = []
    for a, b in ends:
        x, y = top(a), top(b)
        taken.append(x != y)
        root[x] = y
    return taken


def _certificate(ends: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest and one of the other edges: two edges of any cut that has as many, so that bridges are kept."""
    first = _forest(ends)
    rest = [e for e, t in zip(ends, first, strict=True) if not t]
    return [e for e, t in zip(ends, first, strict=True) if t] + [e for e, t in zip(rest, _forest(rest), strict=True) if t]


def bridges(edges: DataFrame, block: int = 1 << 17) -> DataFrame:
    """(a, b): edges that are the only link between their ends.

    Edges in order of their smaller end are reduced in blocks to two edges a node
    at most, which keep all bridges and components, then components of more than
    ``block`` edges likewise; at last one task holds one component.
    """
    ends = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).filter("a <> b").distinct()

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def left() -> pa.RecordBatch:
            kept = _certificate([e for h in held for e in zip(h.column(0).to_pylist(), h.column(1).to_pylist(), strict=True)])
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in kept], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= 2 * block:
                yield left()
                held = []
        if held:
            yield left()

    ends = checkpointed(ends.repartitionByRange("a").sortWithinPartitions("a", "b").mapInArrow(thin, "a long, b long"))
    of = components(ends).select(F.col("node").alias("a"), "component")

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        left = pd.DataFrame(_certificate(list(zip(group["a"].tolist(), group["b"].tolist(), strict=True))), columns=["a", "b"]).astype("int64")
        return left.assign(component=group["component"].iloc[0])

    def find(group: pd.DataFrame) -> pd.DataFrame:
        nodes: dict[int, list[int]] = {}
        for a, b in zip(group["a"].tolist(), group["b"].tolist(), strict=True):
            nodes.setdefault(a, []).append(b)
            nodes.setdefault(b, []).append(a)
        return pd.DataFrame(_bridges(nodes), columns=["a", "b"]).astype("int64")

    live = checkpointed(ends.join(of, "a").select("a", "b", F.col("component").cast("long").alias("component")))
    held, turn = live.count(), 0
    while True:
        large = live.groupBy("component").agg(F.ceil(F.count("*") / block).alias("blocks")).filter("blocks > 1")
        if large.isEmpty():
            break
        dealt = live.join(large, "component", "left").withColumn("block", F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.coalesce("blocks", F.lit(1))))
        live = checkpointed(dealt.filter("blocks > 1").groupBy("component", "block").applyInPandas(reduce, "a long, b long, component long").union(dealt.filter("blocks is null").select("a", "b", "component")))
        held, before, turn = live.count(), held, turn + 1
        if held > 0.9 * before:
            break
    return live.groupBy("component").applyInPandas(find, "a long, b long")


def has_cycle(parents: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """Keys whose parent pointers run in a circle of any length.

    Walks double until they have more steps than any key has nodes: one that
    lasts so long has met a node twice.
    """
    walk = parents.filter(F.col(parent).isNotNull()).select(*keys, F.col(node).alias("n"), F.col(parent).alias("p")).distinct()
    most = walk.groupBy(*keys).agg(F.count_distinct("n").alias("n")).agg(F.max("n")).first()[0] or 0
    steps = 1
    while steps <= most:
        then = walk.select(*keys, F.col("n").alias("p"), F.col("p").alias("to"))
        walk, steps = checkpointed(walk.join(then, [*keys, "p"]).select(*keys, "n", F.col("to").alias("p")).distinct()), 2 * steps
    return walk.select(*keys).distinct()


def broken_merges(merges: DataFrame, source: str, target: str) -> DataFrame:
    """Merge orders whose target is itself merged away: chains and circles."""
    return merges.join(merges.select(F.col(source).alias("__s")), F.col(target) == F.col("__s"), "left_semi")


def outside_largest(top: DataFrame, of: DataFrame, node: str) -> DataFrame:
    """Nodes of ``top`` that aren't in the largest component (the smallest name on ties)."""
    sizes = of.groupBy("component").agg(F.count("*").alias("n"))
    largest = sizes.orderBy(F.desc("n"), "component").limit(1).select(F.col("component").alias("__l"))
    told = top.join(of, top[node] == of["node"], "left").join(largest, F.col("component") == F.col("__l"), "left_anti")
    return told.select(node, "component")


