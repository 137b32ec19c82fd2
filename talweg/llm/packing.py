"""Best-fit packing by length patterns and non-negative least squares.

Documents are cut into pieces of at most ``max_len`` tokens. Only the histogram
of piece lengths (``max_len`` numbers) reaches the driver. There all patterns of
up to ``depth`` lengths that fill a sequence exactly are enumerated, repeat
counts are fitted to the histogram by non-negative least squares, rounded and
kept where pieces remain, and what is left over is packed best-fit decreasing.
Each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from talweg.llm.bpe import encoder
from talweg.llm.common import mapped, written
from talweg.llm.words import filled

#: A pattern (lengths in the order in which they stand in a sequence) and how often it is used.
Strategy = list[tuple[tuple[int, ...], int]]


def patterns(max_len: int, depth: int, present: np.ndarray) -> np.ndarray:
    """All sets of at most ``depth`` (1 to 3) present lengths that sum to ``max_len``: rows of 3 lengths, 0 for none."""
    have = np.flatnonzero(present)
    out = [np.array([[max_len, 0, 0]])] if present[max_len] else []
    if depth >= 2:
        a = have[(have * 2 >= max_len) & (have < max_len)]
        a = a[present[max_len - a] > 0]
        out.append(np.stack([a, max_len - a, np.zeros_like(a)], 1))
    if depth >= 3:
        for a in have[(have * 3 >= max_len) & (have < max_len - 1)].tolist():
            b = have[(have <= a) & (2 * have >= max_len - a) & (have < max_len - a)]
            b = b[present[max_len - a - b] > 0]
            out.append(np.stack([np.full_like(b, a), b, max_len - a - b], 1))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def fit(columns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared error of A x against the histogram (accelerated projected gradient).

    Each column of A has at most three entries, so products with A are gathers
    and bin counts. Errors weigh by length: a long piece left over costs more.
    """
    n = len(histogram)
    weight = np.sqrt(np.arange(n) / (n - 1))
    weight[0] = 0
    b = histogram * weight
    cells, gain = columns.ravel(), weight[columns]

    def product(x: np.ndarray) -> np.ndarray:
        return np.bincount(cells, (x[:, None] * gain).ravel(), n)

    v = np.ones(len(columns))
    for _ in range(20):  # the largest eigenvalue gives the step
        v /= np.linalg.norm(v)
        v = (product(v)[columns] * gain).sum(1)
    step = 1 / (1.05 * np.linalg.norm(v))
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * ((product(y) - b)[columns] * gain).sum(1), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(left: np.ndarray, max_len: int) -> Strategy:
    """Best-fit decreasing over counts of equal lengths; bins of one content are handled together."""
    room: dict[int, list[list]] = defaultdict(list)  # space left -> [content, number of bins]
    for length in range(max_len, 0, -1):
        todo = int(left[length])
        while todo:
            space = next((s for s in range(length, max_len) if room.get(s)), None)
            if space is None:
                per = max_len // length
                bins, rest = divmod(todo, per)
                if bins:
                    room[max_len - per * length].append([(length,) * per, bins])
                if rest:
                    room[max_len - rest * length].append([(length,) * rest, 1])
                break
            held = room[space]
            content, bins = held.pop()
            take = min(bins, todo)
            if bins > take:
                held.append([content, bins - take])
            room[space - length].append([(*content, length), take])
            todo -= take
    return [(content, bins) for held in room.values() for content, bins in held]


def strategy(histogram: np.ndarray, max_len: int, depth: int = 3) -> Strategy:
    """Patterns and counts that hold every piece of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    out: Strategy = []
    columns = patterns(max_len, depth, left > 0)
    if len(columns):
        x = np.rint(fit(columns, left.astype(float))).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if x[i] <= 0:
                break
            lengths = [int(v) for v in columns[i] if v]
            need = {v: lengths.count(v) for v in lengths}
            times = min(int(x[i]), *(int(left[v]) // k for v, k in need.items()))
            if times > 0:
                out.append((tuple(lengths), times))
                for v, k in need.items():
                    left[v] -= k * times
    return out + best_fit(left, max_len)


def places(plan: Strategy, max_len: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its slots, each slot's first sequence and its offset there."""
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for content, times in plan:
        at = 0
        for length in content:
            slots[length].append((times, base, at))
            at += length
        base += times
    out = {}
    for length, found in slots.items():
        n, seq, at = (np.array(v, np.int64) for v in zip(*found, strict=True))
        out[length] = (np.cumsum(n) - n, seq, at)
    return out


def pieces(docs: DataFrame, *, id_col: str, text_col: str, path: str, ranks_path: str | None, max_len: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Token pieces of every text: doc_id, piece, start, length, ids_crc32 (and ids), with their task and rank among its pieces of that length."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, k) for n, k in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("rank", T.LongType())))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, ranks_path)
        part = TaskContext.get().partitionId()
        seen: dict[int, Iterator[int]] = defaultdict(count)
        end = np.array([end_id], "<u4")
        for batch in batches:
            texts = filled(batch.column(1))
            for at, ids, off in code.slices(texts):
                rows: list[list] = [[] for _ in range(8)]
                for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    own = np.concatenate((ids[a:b].astype("<u4"), end))
                    cuts = [0, *range((len(own) - 1) % max_len + 1, len(own) + 1, max_len)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for held, value in zip(rows, (at + i, k, x, y - x, zlib.crc32(own[x:y]), part, next(seen[y - x]), own[x:y].astype(np.int32) if with_ids else None), strict=True):
                            held.append(value)
                out = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5]), pa.array(rows[5], pa.int32()), pa.array(rows[6], pa.int64())]
                if with_ids:
                    out.append(pa.array(rows[7], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return mapped(docs.select(id_col, text_col), cut, schema)


def pack(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    ranks_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = 1024,
    end_id: int = 2,
    depth: int = 3,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``max_len`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and ids). A document's ids end with ``end_id``; only documents
    longer than ``max_len`` are cut, the first piece taking the remainder.
    Null and empty texts are the end id alone; repeated rows are packed each;
    an empty table packs to no rows; other columns are not looked at.

    Shuffles carry a few numbers per piece, keyed by (task, length), so neither
    a common length nor a hot source meets in one task.
    """
    cut = written(pieces(docs, id_col=id_col, text_col=text_col, path=tokenizer_path, ranks_path=ranks_path, max_len=max_len, end_id=end_id, with_ids=with_ids))
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(max_len + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # max_len rows at most
        histogram[r["length"]] = r["n"]
    where = places(strategy(histogram, max_len, depth), max_len)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = cut.join(ahead, ["part", "length"])
    names = [n for n in cut.columns if n not in ("part", "rank")]
    ranked = ranked.select(*names, (F.col("ahead") + F.col("rank")).alias("rank"))
    ids = [n for n in names if n == "ids"]
    schema = T.StructType([*(cut.schema[n] for n in names if n != "ids"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), *(cut.schema[n] for n in ids)])
    shared = docs.sparkSession.sparkContext.broadcast(where)  # slots of at most all patterns of a fixed length

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            seq, at = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for v, rows in zip(values.tolist(), np.split(order, first[1:]), strict=True):
                starts, seqs, offs = shared.value[v]
                k = np.searchsorted(starts, rank[rows], side="right") - 1
                seq[rows], at[rows] = seqs[k] + rank[rows] - starts[k], offs[k]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(at), *(batch.column(batch.schema.get_field_index(n)) for n in ids)], names=schema.names)

    return mapped(ranked, seat, schema)
