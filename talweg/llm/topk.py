"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are grouped into buckets of similar length, longest first. A first look
at the longest buckets gives each query a score that it will reach at least.
For a bucket, that score over the product of the query's and the bucket's
greatest length is the local cosine threshold: above 1 the whole bucket is
passed over, and as buckets get shorter a query needs a first few of them only.
Queries are put in blocks with others that need as many, so that neither queries
nor vectors travel to where nothing can be found. In a bucket, a coordinate bound
thins the vectors where the threshold is high, the length bound where it is low.
What remains is verified by exact integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talweg.llm.common import written

#: Above this local cosine threshold the coordinate bound pays.
COORDINATE_AT = 0.6
#: Coordinates that the bound looks at.
FOCUS = 8


def quantised(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id, ``q`` (floor(scale * x) of each component as double), ``norm`` and ``is_query`` of the rows that take part."""
    v = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("q"), fine.alias("fine"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter("fine")
    return rows.drop("fine").withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(arrays: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of one width from the lists' flat values; shorter vectors count as zero-padded."""
    lists = arrays.combine_chunks()
    off = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), width))
    out[row, np.arange(len(row)) - (off[:-1] - off[0])[row]] = lists.flatten().to_numpy()
    return out


def search_block(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, vector, score) of what may be among the k best of each query in one bucket; ``least`` is the score to reach."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    length = np.sqrt((v * v).sum(1))
    q_length = np.sqrt((q * q).sum(1))
    top = length.max(initial=0.0)
    reach = q_length * top
    live = np.flatnonzero(reach * (1 + 1e-12) >= least)
    if not len(live):
        return []
    out: list[tuple[int, int, float]] = []
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(reach > 0, least / reach, -1.0)
    coordinate = live[cosine[live] > COORDINATE_AT]
    whole = live[cosine[live] <= COORDINATE_AT]

    def keep(rows: int, places: np.ndarray, scores: np.ndarray) -> None:
        fine = (scores >= least[rows]) & (ids[places] != q_ids[rows])
        places, scores = places[fine], scores[fine]
        if len(places) > k:
            best = np.lexsort((ids[places], -scores))[:k]
            places, scores = places[best], scores[best]
        out.extend((int(q_ids[rows]), int(a), float(b)) for a, b in zip(ids[places], scores, strict=True))

    if len(coordinate):
        unit = v / np.maximum(length, 1e-300)[:, None]
        for i in coordinate:
            u = q[i] / q_length[i]
            focus = np.argsort(-np.abs(u))[:FOCUS]
            # Cauchy-Schwarz on the rest: u.x <= u_F.x_F + |u_R| |x_R|, |x| = 1
            part = unit[:, focus]
            bound = part @ u[focus] + np.sqrt(np.maximum(0, 1 - (u[focus] ** 2).sum())) * np.sqrt(np.maximum(0, 1 - (part * part).sum(1)))
            places = np.flatnonzero(bound * length * q_length[i] * (1 + 1e-9) + 1e-6 >= least[i])
            if len(places):
                keep(i, places, v[places] @ q[i])
    if len(whole):
        products = q[whole] @ v.T
        for row, i in enumerate(whole):
            needed = least[i] / q_length[i] if q_length[i] > 0 else -np.inf
            scores = products[row]
            places = np.flatnonzero((scores >= least[i]) & (length * (1 + 1e-12) >= needed) & (ids != q_ids[i]))
            if len(places) > 8 * k:
                cut = -np.partition(-scores[places], k)[k]
                places = places[scores[places] >= cut]
            keep(i, places, scores[places])
    return out


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
    lengths: int = 32,
    block_rows: int = 4000,
    query_rows: int = 1000,
) -> DataFrame:
    """The k best rows for each query row: query_id, rank (from 1), vec_id, score (integer inner product).

    Candidates are all rows with another id than the query's; ties go to the
    smaller id; all are returned where there are fewer than k. Vectors that are
    null, or hold null or non-finite components, and rows without an id take no
    part; shorter vectors count as zero-padded. Rows that repeat an id are
    candidates of their own, so an id may come up more than once for a query;
    rows that repeat a query's id are one query, and each of them meets every
    candidate. Other columns are not looked at; an empty table gives no rows.
    Scores are exact as long as products stay below 2**53.

    There are at most ``lengths`` buckets of similar length, cut into blocks of
    about ``block_rows``; blocks of about ``query_rows`` queries that need equally
    many buckets meet the blocks of these and return at most k rows a query row.
    """
    rows = written(quantised(vectors, is_query, id_col, vec_col, scale))
    stats = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("queries"), F.max(F.size("q")).alias("width")).first()
    n, width = stats["n"], stats["width"] or 0
    if not n or not stats["queries"]:
        return rows.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    n_lengths = min(lengths, -(-n // block_rows))
    bounds = sorted(set(rows.approxQuantile("norm", [i / n_lengths for i in range(1, n_lengths)], 0.2 / n_lengths))) if n_lengths > 1 else []
    rows = rows.withColumn("bucket", F.size(F.filter(F.lit(bounds), lambda b: b > F.col("norm"))) if bounds else F.lit(0))
    found = {r["bucket"]: r for r in rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}  # one row per length bucket
    parts = [-(-found[b]["n"] // block_rows) if b in found else 0 for b in range(len(bounds) + 1)]
    tops = [max((r["top"] for c, r in found.items() if c >= b), default=0.0) for b in range(len(parts))]
    ahead = [sum(parts[:b]) for b in range(len(parts) + 1)]
    at = F.col("bucket") + 1
    rows = rows.withColumn("place", (F.element_at(F.lit(ahead), at) + F.pmod(F.xxhash64("id", "q"), F.greatest(F.element_at(F.lit(parts), at), F.lit(1)))).cast("int"))
    first = next(b for b, m in enumerate(parts) if m) + 1  # buckets of the first look

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            ids, v = right.column("id").to_numpy(), _matrix(right.column("q"), width)
            for i in range(0, left.num_rows, 128):
                some = left.slice(i, 128)
                out += search_block(some.column("id").to_numpy(), _matrix(some.column("q"), width), some.column("least").to_numpy(), ids, v, k)
        columns = np.array([(q, v) for q, v, _ in out], np.int64).reshape(-1, 2)
        return pa.table({"query_id": columns[:, 0], "vec_id": columns[:, 1], "score": np.array([s for *_, s in out]).astype(np.int64)})

    def against(asked: DataFrame, low: int, high: int) -> DataFrame:
        """Queries (id, q, least, depth: how many buckets each needs) against the buckets from ``low`` to before ``high``."""
        asked = asked.filter(F.col("depth") > low)
        counts = {r["depth"]: r["n"] for r in asked.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # one row per length bucket
        blocks = [-(-counts.get(d, 0) // query_rows) for d in range(len(parts) + 1)]
        if not sum(blocks):
            return rows.limit(0).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
        since = [sum(blocks[:d]) for d in range(len(parts) + 1)]  # the first block of each depth; deeper ones follow
        depth = F.col("depth") + 1
        block = (F.element_at(F.lit(since), depth) + F.pmod(F.xxhash64("id", "q"), F.element_at(F.lit(blocks), depth))).cast("int")
        end = F.element_at(F.lit(ahead), F.least(depth, F.lit(high + 1)))
        left = asked.select("id", "q", "least", block.alias("block"), F.explode(F.filter(F.sequence(F.lit(ahead[low]), F.greatest(end - 1, F.lit(ahead[low]))), lambda p: p < end)).alias("place"))
        some = rows.filter(F.col("bucket").between(low, high - 1)).withColumn("since", F.element_at(F.lit(since), F.col("bucket") + 2))  # blocks of queries that need more buckets than lie before this one
        right = some.filter(F.col("since") < sum(blocks)).select(*[F.col(c).alias(c) for c in ("id", "q", "place")], F.explode(F.sequence("since", F.lit(sum(blocks) - 1))).alias("block"))
        return left.groupBy("place", "block").cogroup(right.groupBy("place", "block")).applyInArrow(search, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = rows.filter("is_query").select(*[F.col(c).alias(c) for c in ("id", "q", "norm")])
    seeds = against(queries.withColumn("least", F.lit(float("-inf"))).withColumn("depth", F.lit(first)), first - 1, first)
    seeds = written(seeds.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    best = seeds.drop("rank")
    if sum(parts) > ahead[first]:
        reached = seeds.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
        asked = queries.join(reached, "id", "left").fillna(float("-inf"), ["least"])
        # buckets get shorter, so the ones that can matter come first
        asked = written(asked.withColumn("depth", F.size(F.filter(F.lit(tops), lambda top: F.col("norm") * top * (1 + 1e-12) >= F.col("least")))).select("id", "q", "least", "depth"))
        best = best.unionByName(against(asked, first, len(parts)))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
