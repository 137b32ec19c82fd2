"""Repeated passages across documents by sparse suffix arrays.

Suffixes are retained only where a word k-gram is the smallest (by hash) of some
window of w consecutive k-grams. The choice depends on content alone, so two
copies of a passage of at least w + k - 1 words retain the same suffixes.
Suffixes whose k-gram occurs in one document only are let go; the others are
sorted by what follows them and then by what precedes them, neighbours of
different documents are compared word by word, and matches are extended to the
right and left. As a suffix may share more of its left with one that isn't its
neighbour, a task's suffixes are also sorted by every ``min_words``-word stretch
around them; a stretch that may lie in several tasks is counted across them.
Matches of ``min_words`` or more are joined into passages.

A suffix carries ``min_words`` words to its right and ``min_words - k`` to its
left; longer passages hold several suffixes, whose matches overlap.

Where a text repeats itself (a word or a phrase over and over), every repeat
ties for the smallest k-gram. Repeats of one k-gram in one document, each at
most ``min_words`` after the one before, travel as one chain; those among them
with equal words on both sides are one suffix with a first and a last place, as
whatever the first of them matches the others match too, and as matches are
longer than the steps between them their ranges have no gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.llm.common import mapped, partitions, written
from talweg.llm.words import Words, filled, mix, parts, signed, slices

#: k, w and the least words of a passage; k + w - 1 < MIN_WORDS, so that every passage retains a suffix.
K, W, MIN_WORDS = 18, 32, 50


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` (a power of two) values."""
    step = 1
    while step < width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


def minimisers(grams: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Places in ``grams`` that are the smallest of some window of w within their text."""
    n = len(grams)
    if n < w:
        return np.empty(0, np.int64)
    low = _sliding(grams, w, np.minimum)
    whole = np.zeros(n + 1, np.int32)  # windows that lie within one text
    counts = np.diff(first) - w + 1
    live = counts > 0
    np.add.at(whole, first[:-1][live], 1)
    np.add.at(whole, first[:-1][live] + counts[live], -1)
    low = np.where(np.cumsum(whole[: len(low)]) > 0, low, np.uint64(0))
    edge = np.zeros(w - 1, np.uint64)
    best = _sliding(np.concatenate((edge, low, edge)), w, np.maximum)
    return np.flatnonzero((best == grams) & (best > 0))


def shared_suffixes(docs: DataFrame, k: int, w: int, step: int) -> DataFrame:
    """(id, key, pos, last): chains of retained suffixes whose k-gram occurs under two ids or more. ``docs``: id, text.

    A chain holds the places of one k-gram in one document that follow each other by ``step`` words at most.
    """

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, id, pos, last, kind): kind 0 not yet known to be shared, 1 known, 2 known and needed no more for telling others."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, ids, pos = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((pos, ids, key))
            key, ids, pos = key[order], ids[order], pos[order]
            heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (pos[1:] - pos[:-1] > step)))
            last = pos[np.append(heads[1:], len(pos)) - 1]
            key, ids, pos = key[heads], ids[heads], pos[heads]
            new = np.append(True, key[1:] != key[:-1])
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            several = ids[np.append(starts[1:], len(key)) - 1] != ids[starts]
            kind = np.where(several[run], np.where(new, 1, 2), 0).astype(np.int8)
            yield from parts(pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(ids), pa.array(pos), pa.array(last), pa.array(kind)], names=["key", "id", "pos", "last", "kind"]))

        for batch in batches:
            texts, ids = filled(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            for at, to in slices(texts):
                words = Words(texts.slice(at, to - at))
                grams, first = words.grams(k)
                best = minimisers(grams, first, w)
                doc = np.searchsorted(first, best, side="right") - 1
                held.append((grams[best], ids[at:to][doc], (best - first[doc]).astype(np.int32)))
                size += len(best)
            if size > 1_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches]
        if not held:
            return
        key, ids, pos, last, kind = (np.concatenate(c) for c in zip(*held, strict=True))
        told = kind == 2
        keep = np.flatnonzero(told)
        rest = np.flatnonzero(~told)
        order = rest[np.lexsort((ids[rest], key[rest]))]
        if len(order):
            new = np.append(True, key[order][1:] != key[order][:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(order))
            shared = (ids[order[ends - 1]] != ids[order[starts]]) | (np.maximum.reduceat(kind[order], starts) == 1)
            keep = np.concatenate((keep, order[np.repeat(shared, ends - starts)]))
        yield from parts(pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (ids, key, pos, last)], names=["id", "key", "pos", "last"]))

    # a common k-gram sends one row a task to its place; its other rows go by document
    dealt = mapped(docs, retain, "key long, id long, pos int, last int, kind byte").repartition(F.when(F.col("kind") == 2, F.xxhash64("id", "pos")).otherwise(F.col("key")))
    return mapped(dealt, share, "id long, key long, pos int, last int")


def _fixed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    n, width = len(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


CONTEXT = "key long, right binary, left binary, id long, pos int, last int, n_right int, n_left int"


def contexts(docs: DataFrame, suffixes: DataFrame, k: int, min_words: int) -> DataFrame:
    """Each suffix with the words to its right (its k-gram first) and to its left (nearest first), as 32-bit hashes; ``last`` is its last place in a chain of equal contexts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, back = np.arange(min_words), np.arange(1, min_words - k + 1)
        for batch in batches:
            texts = filled(batch.column(1))
            held = batch.column(2)
            off = held.offsets.to_numpy()
            flat = held.values
            pos_all, last_all, key_all = (flat.field(i).to_numpy() for i in (0, 1, 2))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, to in slices(texts):
                words = Words(texts.slice(at, to - at))
                grams, first = words.grams(k)
                short = (words.hash >> np.uint64(32)).astype(np.uint32)
                low, high, key = (x[off[at] : off[to]] for x in (pos_all, last_all, key_all))
                doc = np.repeat(np.arange(to - at), np.diff(off[at : to + 1]))
                # rows that repeat an id may bring places of another text
                size = np.maximum(np.minimum(high, np.diff(first)[doc] - 1) - low + 1, 0)
                chain = np.repeat(np.arange(len(key)), size)
                pos = np.arange(len(chain)) - np.repeat(np.cumsum(size) - size - low, size)
                fine = signed(grams)[first[doc[chain]] + pos] == key[chain]
                chain, pos = chain[fine], pos[fine]
                for i in range(0, len(pos), 20_000):
                    p, of = pos[i : i + 20_000], chain[i : i + 20_000]
                    d = doc[of]
                    here = words.first[d] + p
                    n_right, n_left = np.minimum(words.n[d] - p, min_words), np.minimum(p, min_words - k)
                    right = np.where(ahead < n_right[:, None], short[np.minimum(here[:, None] + ahead, len(short) - 1)], np.uint32(0))
                    left = np.where(back <= n_left[:, None], short[np.maximum(here[:, None] - back, 0)], np.uint32(0))
                    equal = (of[1:] == of[:-1]) & (p[1:] - p[:-1] <= min_words) & (n_right[1:] == n_right[:-1]) & (n_left[1:] == n_left[:-1]) & (right[1:] == right[:-1]).all(1) & (left[1:] == left[:-1]).all(1)
                    head = np.flatnonzero(np.append(True, ~equal))
                    last = p[np.append(head[1:], len(p)) - 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[of[head]]), _fixed(right[head]), _fixed(left[head]), pa.array(ids[at:to][d[head]]), *(pa.array(x.astype(np.int32)) for x in (p[head], last, n_right[head], n_left[head]))],
                        names=["key", "right", "left", "id", "pos", "last", "n_right", "n_left"],
                    )

    places = suffixes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "last", "key"))).alias("places"))
    return mapped(docs.join(places.hint("merge"), "id").select("id", "text", "places"), cut, CONTEXT)


MATCH = "id long, start int, end int, earlier boolean"


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    width = len(column[0].as_py()) // 4 if n else 1
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint32).reshape(n, width)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    same = a == b
    return np.minimum(np.where(same.all(1), a.shape[1], np.argmin(same, 1)), most)


def _hashes(right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, min_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each r the rows with a stretch of ``min_words`` that begins r words before the suffix, and the stretches' hashes."""
    ahead = np.zeros((right.shape[1] + 1, len(right)), np.uint64)
    for j in range(right.shape[1]):  # one constant for each place of a word: sums tell stretches apart
        ahead[j + 1] = ahead[j] + mix(right[:, j] + np.uint64(j << 32) + np.uint64(1))
    back = np.zeros(len(right), np.uint64)
    for r in range(left.shape[1] + 1):
        if r:
            back = back + mix(left[:, r - 1] + np.uint64((0x8000 + r) << 32))
        whole = np.flatnonzero((n_left >= r) & (n_right >= min_words - r))
        if len(whole):
            yield r, whole, ahead[min_words - r][whole] + back[whole]


def _least_and_largest(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """The order by hash, the starts of equal hashes in it, and their smallest and largest ids."""
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    starts = np.flatnonzero(np.append(True, sorted_h[1:] != sorted_h[:-1]))
    return order, starts, np.minimum.reduceat(ids[order], starts), np.maximum.reduceat(ids[order], starts)


class _Hits:
    """The least and most r of each row's stretches that other documents (0) or earlier ones (1) have."""

    def __init__(self, ids: np.ndarray, pos: np.ndarray, last: np.ndarray, min_words: int):
        self.ids, self.pos, self.last, self.min_words = ids, pos, last, min_words
        self.least, self.most = np.full((2, len(ids)), min_words + 1, np.int64), np.full((2, len(ids)), -1, np.int64)

    def add(self, r: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        for k, hit in enumerate((rows[low != high], rows[low < self.ids[rows]])):
            self.least[k, hit] = np.minimum(self.least[k, hit], r)
            self.most[k, hit] = r

    def found(self) -> list[tuple[np.ndarray, ...]]:
        """Matches as (id, start, end, earlier): a row's stretches all hold its k-gram, so that they overlap."""
        out = []
        for k in (0, 1):
            hit = np.flatnonzero(self.most[k] >= 0)
            out.append((self.ids[hit], self.pos[hit] - self.most[k, hit], self.last[hit] - self.least[k, hit] + self.min_words, np.full(len(hit), k == 1)))
        return out


def stretches(ids: np.ndarray, pos: np.ndarray, last: np.ndarray, right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, min_words: int) -> list[tuple[np.ndarray, ...]]:
    """Matches as (id, start, end, earlier) from stretches of ``min_words`` that begin r words before a suffix, for each r."""
    hits = _Hits(ids, pos, last, min_words)
    for r, whole, h in _hashes(right, left, n_right, n_left, min_words):
        order, starts, low, high = _least_and_largest(h, ids[whole])
        times = np.diff(np.append(starts, len(h)))
        hits.add(r, whole[order], np.repeat(low, times), np.repeat(high, times))
    return hits.found()


def reach(key: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Words to its right that each sorted suffix shares with the first or last one: a stretch with more of them lies in this task only."""
    best = np.zeros(len(key), np.int64)
    for end in (0, len(key) - 1):
        same = np.flatnonzero(key == key[end])
        best[same] = np.maximum(best[same], _common(right[same], right[end : end + 1], n_right[same]))
    return best


def _columns(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """key, id, pos, last, n_right, n_left, right and left of rows."""
    one = [rows.column(c).combine_chunks() if rows.column(c).num_chunks != 1 else rows.column(c).chunk(0) for c in ("right", "left")]
    return *(rows.column(c).to_numpy() for c in ("key", "id", "pos", "last", "n_right", "n_left")), *(_matrix(c, rows.num_rows) for c in one)


def compare(rows: pa.Table, min_words: int) -> tuple[pa.RecordBatch, pa.RecordBatch, np.ndarray]:
    """Of a task's sorted suffixes: their matches; the stretches that other tasks may have too (hash, smallest and largest id); and the places of the suffixes with such stretches."""
    key, ids, pos, last, n_right, n_left, right, left = _columns(rows)
    n = rows.num_rows
    new = np.append(True, (ids[1:] != ids[:-1]) | (key[1:] != key[:-1]))
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    ends = np.append(starts[1:], n)
    found = []
    for other in (starts[run] - 1, ends[run]):  # the neighbours before and after a document's run
        mine = np.flatnonzero((other >= 0) & (other < n))
        mine = mine[key[other[mine]] == key[mine]]
        for some in np.array_split(mine, max(1, len(mine) // 50_000)):
            it = other[some]
            ahead = _common(right[some], right[it], np.minimum(n_right[some], n_right[it]))
            back = _common(left[some], left[it], np.minimum(n_left[some], n_left[it]))
            long = ahead + back >= min_words
            some, it, ahead, back = some[long], it[long], ahead[long], back[long]
            found.append((ids[some], pos[some] - back, last[some] + ahead, ids[it] < ids[some]))
    found += stretches(ids, pos, last, right, left, n_right, n_left, min_words)
    near = reach(key, right, n_right)
    border = np.flatnonzero(near + n_left >= min_words)
    partial = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for r, whole, h in _hashes(right[border], left[border], n_right[border], n_left[border], min_words):
        some = near[border[whole]] >= min_words - r
        if some.any():
            order, starts, low, high = _least_and_largest(h[some], ids[border[whole[some]]])
            partial.append((h[some][order[starts]], low, high))
    hashes, low, high = (np.concatenate(c) for c in zip(*partial, strict=True))
    ends = pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(low), pa.array(high)], names=["hash", "low", "high"])
    return _matches(found), ends, border


def _matches(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int32, np.int32, bool), strict=True)], names=["id", "start", "end", "earlier"])


def settled(rows: pa.Table, told: pa.Table, min_words: int) -> pa.Table:
    """Matches that one task's border suffixes have in other tasks only, by stretches (hash, smallest and largest id over all tasks, smallest here as own)."""
    if not rows.num_rows or not told.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.bool_())], ["id", "start", "end", "earlier"])
    _, ids, pos, last, n_right, n_left, right, left = _columns(rows)
    order = np.argsort(told.column("hash").to_numpy())
    known, low, high, own = (told.column(c).to_numpy()[order] for c in ("hash", "low", "high", "own"))
    hits = _Hits(ids, pos, last, min_words)
    for r, whole, h in _hashes(right, left, n_right, n_left, min_words):
        at = np.minimum(np.searchsorted(known, signed(h)), len(known) - 1)
        hit = (known[at] == signed(h)) & (ids[whole] == own[at])  # other ids have an earlier one here
        hits.add(r, whole[hit], low[at[hit]], high[at[hit]])
    return pa.Table.from_batches([_matches(hits.found())])


def matches(suffixes: DataFrame, min_words: int) -> DataFrame:
    """(id, start, end, earlier): word ranges equal to a range of another document; ``earlier`` where that has a smaller id.

    As suffixes are sorted by what follows, a stretch that several tasks have
    begins, from the suffix on, as the first or last suffix of each of them. Each
    task lists such stretches with its smallest and largest id of each, and learns
    those over all tasks.
    """
    order = ["key", "right", "left", "id", "pos"]
    array = suffixes.repartitionByRange(partitions(suffixes.sparkSession), *order).sortWithinPartitions(*order)
    match, end = (T._parse_datatype_string(x) for x in (MATCH, "hash long, low long, high long"))
    schema = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("match", match), T.StructField("end", end), T.StructField("suffix", suffixes.schema)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        found, ends, border = compare(rows, min_words)
        kinds = {"match": [found], "end": [ends], "suffix": rows.take(pa.array(border)).to_batches()}
        types = {"match": pa.struct(found.schema), "end": pa.struct(ends.schema), "suffix": pa.struct(rows.schema)}
        task = TaskContext.get().partitionId()
        for kind, some in kinds.items():
            for b in (piece for whole in some for piece in parts(whole, 10_000)):
                columns = [pa.StructArray.from_arrays(b.columns, fields=list(b.schema)) if kind == n else pa.nulls(b.num_rows, t) for n, t in types.items()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, task, np.int32)), *columns], names=["task", *types])

    every = written(mapped(array, each, schema))
    inner = every.filter("match is not null").select("match.*")
    ends = every.filter("end is not null").groupBy("end.hash").agg(F.min("end.low").alias("low"), F.max("end.high").alias("high"), F.collect_list(F.struct("task", F.col("end.low").alias("own"), F.col("end.high").alias("last"))).alias("tasks"))
    # a task that has the smallest id and another one knows all of its matches
    news = ends.filter("size(tasks) > 1 and low < high").select(F.explode("tasks").alias("of"), "hash", "low", "high").filter("of.own > low or of.own = of.last")
    told = news.select("of.task", "hash", "low", "high", "of.own")
    borders = every.filter("suffix is not null").select("task", "suffix.*")
    return inner.union(borders.groupBy("task").cogroup(told.groupBy("task")).applyInArrow(lambda rows, told: settled(rows, told, min_words), MATCH))


def passages(matched: DataFrame) -> DataFrame:
    """(id, start, end): overlapping and touching ranges of each document joined."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None
        for batch in batches:
            out = []
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and last[0] == i and a <= last[2]:
                    last = (i, last[1], max(b, last[2]))
                else:
                    if last:
                        out.append(last)
                    last = (i, a, b)
            if out:
                yield _ranges(out)
        if last:
            yield _ranges([last])

    dealt = matched.select("id", "start", "end").distinct().repartition("id").sortWithinPartitions("id", "start")
    return mapped(dealt, join, "id long, start int, end int")


def _ranges(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "start", "end"])


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = K, w: int = W, only_later: bool = False) -> DataFrame:
    """Passages of ``min_words`` words or more that stand in several documents: id, start, end (words from 0, end exclusive).

    Words are runs of other than blanks, A-Z lower-cased. With ``only_later``
    the ranges that a document with a smaller id has too: taking these away
    leaves every passage in place once. Rows that share an id are one document:
    repeats among them don't count, and a range may belong to any of them. Null
    and empty texts and null ids have no passages; an empty table gives no rows;
    other columns are not looked at.
    """
    if k + w - 1 >= min_words or w & (w - 1):
        raise ValueError("k + w - 1 must be below min_words and w a power of two")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    found = matches(contexts(base, shared_suffixes(base, k, w, min_words), k, min_words), min_words)
    return passages(found.filter("earlier") if only_later else found)


def without(docs: DataFrame, ranges: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with the words of ``ranges`` (id, start, end) taken out of its texts; rows that lose every word go.

    Blanks around what is cut stay with what follows. ``chars_col`` is set to the new length of changed texts.
    """
    names = docs.columns
    cuts = ranges.groupBy(F.col("id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = rows.join(cuts.hint("merge"), F.col("id") == F.col("of"), "left").select("doc", "text", "cuts")
    schema = T.StructType([joined.schema["doc"], T.StructField("text", T.StringType()), T.StructField("left", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, left = [], []
            for text, gaps in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                if not gaps or not text.is_valid:
                    out.append(text.as_py())
                    left.append(-1)
                    continue
                w = Words(pa.array([text.as_py()]))
                body, at, parts = w.body.tobytes(), 0, []
                rest = len(w.start)
                for g in gaps:
                    a, b = g["start"], min(g["end"], len(w.start))
                    if a < b:
                        parts.append(body[at : w.start[a]])
                        at = int(w.start[b]) if b < len(w.start) else len(body)
                        rest -= b - a
                out.append((b"".join(parts) + body[at:]).decode())
                left.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(left, pa.int64())], names=["doc", "text", "left"])

    done = mapped(joined, cut, schema).filter("left <> 0")
    values = {c: F.col("doc").getField(c) for c in names} | {text_col: F.col("text")}
    if chars_col:
        values[chars_col] = F.when(F.col("left") > 0, F.length("text")).otherwise(F.col("doc").getField(chars_col)).cast(docs.schema[chars_col].dataType)
    return done.select(*[values[c].alias(c) for c in names])
