"""Language-model scoring by subword lattice likelihood.

A vocabulary of pieces with unigram weights assigns every way of segmenting a
text a probability; the text's probability is the sum over all of them, from a
forward recursion in log space. Pieces never cross blanks, so a text's
lattice falls apart into its words, and each distinct word of a block of
documents is computed once, words of equal length together.

The weights start from the scores of an existing vocabulary and are re-estimated
by one round of expected counts (forward-backward) over all training text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.llm.common import mapped, written
from talweg.llm.words import BASE, Words, filled, mix, offsets, signed, slices
from talweg.llm.words import parts as cut

#: A piece's leading mark of a word's beginning, as one byte that no word holds.
SPACE = 0x20
#: Starting weight of a byte piece, and the strength of the starting weights in pieces.
BYTE_WEIGHT, PRIOR = 1e-6, 1000.0
#: Bytes of text after which a block ends; its last text may reach beyond.
BLOCK_BYTES = 12_000_000
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_TABLE_BITS = 20
_MASK = np.uint64((1 << _TABLE_BITS) - 1)
_loaded: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces as byte strings with starting probabilities, found by hash; the last one stands for a text's end."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = list(pieces)
        start = np.array(list(pieces.values()), np.float64)
        self.start = np.append(start / start.sum() * 0.999, 0.001)
        self.longest = max(map(len, self.pieces))
        keys = np.array([piece_hash(p) for p in self.pieces], np.uint64)
        self._keys = np.append(keys, np.uint64(0))
        # a small table tells most absent pieces; what collides in the next one stands in the last
        self._seen = np.zeros(1 << _TABLE_BITS, bool)
        self._seen[(keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self._tables = []
        left = np.arange(len(keys))
        for shift in (64 - _TABLE_BITS, 64 - 2 * _TABLE_BITS):
            table = np.full(1 << _TABLE_BITS, len(keys), np.int32)
            slot = (keys[left] >> np.uint64(shift)) & _MASK
            _, first = np.unique(slot, return_index=True)
            table[slot[first].astype(np.int64)] = left[first]
            self._tables.append((np.uint64(shift), table))
            left = np.delete(left, first)
        if len(left):
            raise ValueError("piece hashes collide twice")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's piece number; the number of pieces where there is none."""
        out = np.full(h.shape, len(self.pieces), np.int32)
        flat = h.ravel()
        maybe = np.flatnonzero(self._seen[(flat >> np.uint64(64 - _TABLE_BITS)).view(np.int64)])
        for shift, table in self._tables:
            some = flat[maybe]
            at = table[((some >> shift) & _MASK).view(np.int64)]
            hit = self._keys[at] == some
            out.ravel()[maybe[hit]] = at[hit]
            maybe = maybe[~hit]
        return out

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Pieces of a sentencepiece model. Scores that are log probabilities are taken as such; scores that count merges, as ranks of a Zipf law."""
        if path not in _loaded:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            found: dict[bytes, float] = {}
            scores = []
            for i in range(model.get_piece_size()):
                text = model.id_to_piece(i).replace("▁", " ")
                if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or " " in text[1:] or any(0x41 <= b <= 0x5A or b in range(9, 14) for b in text.encode()):
                    continue
                found[text.encode()] = score = model.get_score(i)
                scores.append(score)
            logs = min(scores) > -100  # merge counts run to minus the number of pieces
            weights = {p: float(np.exp(s)) if logs else 1 / (10 - s) for p, s in found.items()}
            whole = sum(weights.values())
            weights = {p: w / whole for p, w in weights.items()}
            for b in range(256):
                weights.setdefault(bytes([b]), BYTE_WEIGHT)
            _loaded[path] = cls(weights)
        return _loaded[path]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(BASE)
    return tuple(np.array([pow(base, sign * i, 1 << 64) for i in range(n)], np.uint64) for sign in (1, -1))


def piece_hash(piece: bytes) -> int:
    up, _ = _powers(len(piece))
    return int((_CODES[np.frombuffer(piece, np.uint8)] * up).sum())


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top).sum(0))


class Lattice:
    """The lattices of words of one length (bytes, one word to a row)."""

    def __init__(self, vocabulary: Vocabulary, words: np.ndarray):
        self.v = vocabulary
        m, n = words.shape
        self.n = n + 1  # with the leading space
        codes = np.empty((self.n, m), np.uint64)
        up, down = _powers(self.n + 1)
        codes[0] = _CODES[SPACE]
        codes[1:] = _CODES[words.T]
        codes *= up[: self.n, None]
        total = np.zeros((self.n + 1, m), np.uint64)
        np.cumsum(codes, axis=0, out=total[1:])
        self.at: list[np.ndarray] = []  # for each end: a row of piece numbers for each length, from 1 on
        for j in range(1, self.n + 1):
            sizes = np.arange(1, min(j, vocabulary.longest) + 1)
            self.at.append(vocabulary.find((total[j] - total[j - sizes]) * down[j - sizes][:, None]))

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """log of the summed probability of all segmentations up to each place; ``log_p`` ends with -inf for no piece."""
        alpha = np.zeros((self.n + 1, self.at[0].shape[1]))
        for j in range(1, self.n + 1):
            at = self.at[j - 1]
            alpha[j] = _log_sum(alpha[j - len(at) : j][::-1] + log_p[at])
        return alpha

    def expected(self, log_p: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
        """Add each piece's expected count, words taken by weight."""
        alpha = self.forward(log_p)
        beta = np.full_like(alpha, -np.inf)
        beta[self.n] = 0
        terms: list[list[np.ndarray]] = [[] for _ in range(self.n + 1)]
        for j in range(self.n, 0, -1):
            if j < self.n:
                beta[j] = _log_sum(np.stack(terms[j]))
            at = self.at[j - 1]
            tail = log_p[at] + beta[j]
            for size in range(1, len(at) + 1):
                terms[j - size].append(tail[size - 1])
            share = np.exp(alpha[j - len(at) : j][::-1] + tail - alpha[self.n]) * weights
            out += np.bincount(at.ravel(), share.ravel(), len(out))
            terms[j] = []


def by_length(body: np.ndarray, start: np.ndarray, end: np.ndarray, cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of one length: their places, and their bytes with A-Z folded."""
    size = end - start
    if not len(size):
        return
    order = np.argsort(size, kind="stable")
    values, first = np.unique(size[order], return_index=True)
    for n, rows in zip(values.tolist(), np.split(order, first[1:]), strict=True):
        for i in range(0, len(rows), step := max(1, cells // (n * min(n, 16)))):
            some = rows[i : i + step]
            chars = body[start[some][:, None] + np.arange(n)]
            yield some, np.where((chars >= 0x41) & (chars <= 0x5A), chars + np.uint8(32), chars)


def _distinct(texts: pa.Array) -> tuple[list[tuple[int, int, Words, np.ndarray]], np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Words of all slices, the sorted distinct hashes, and where each distinct word first stands: (slice, places in it, places among the distinct)."""
    parts, firsts, hashes = [], [], []
    for at, to in slices(texts):
        w = Words(texts.slice(at, to - at))
        h, one, each = np.unique(w.hash, return_index=True, return_inverse=True)
        parts.append((at, to, w, each))
        firsts.append(one)
        hashes.append(h)
    if not parts:
        return [], np.empty(0, np.uint64), []
    flat = np.concatenate(hashes)
    distinct, one, each = np.unique(flat, return_index=True, return_inverse=True)
    out, places, low = [], [], 0
    for i, ((at, to, w, own), first) in enumerate(zip(parts, firsts, strict=True)):
        here = each[low : low + len(first)]
        out.append((at, to, w, here[own]))
        mine = (one >= low) & (one < low + len(first))
        places.append((i, first[one[mine] - low], np.flatnonzero(mine)))
        low += len(first)
    return out, distinct, places


def marginals(vocabulary: Vocabulary, log_p: np.ndarray, parts: list, n: int, places: list) -> np.ndarray:
    """log probability of each of n distinct words."""
    out = np.zeros(n)
    for i, at, among in places:
        w = parts[i][2]
        for rows, chars in by_length(w.body, w.start[at], w.end[at]):
            lattice = Lattice(vocabulary, chars)
            out[among[rows]] = lattice.forward(log_p)[-1]
    return out


COUNTS = "block long, key long, n double, first boolean"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` (with text) and each row's block: a partition's rows in their order, cut every ``BLOCK_BYTES``."""
    at, limit = docs.columns.index("text"), BLOCK_BYTES

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = done + np.cumsum(np.diff(offsets(filled(batch.column(at)))))
            blocks = first + np.append(done, ends[:-1]) // limit
            done = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks)], names=[*batch.schema.names, "block"])

    return mapped(docs, number, T.StructType([*docs.schema.fields, T.StructField("block", T.LongType())]))


def word_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """What the corpus teaches, as (block, key, n, first).

    For each block of documents and distinct word: the word's hash and its count
    in all training text; ``first`` marks one row per word. A block that several
    tasks read has a row for each of them. Block -1 holds expected piece counts,
    to be summed by key. ``docs``: text, held_out, block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(vocabulary_path)
        with np.errstate(divide="ignore"):
            log_p = np.append(np.log(vocabulary.start[:-1]), -np.inf)
        pieces = np.zeros(len(log_p))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ends, block = 0, -1

        def rows(block: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            size = len(keys)
            yield from cut(pa.RecordBatch.from_arrays([pa.array(np.full(size, block, np.int64)), pa.array(keys.astype(np.int64)), pa.array(n), pa.array(np.zeros(size, bool))], names=["block", "key", "n", "first"]))

        def told() -> Iterator[pa.RecordBatch]:
            keys, each = np.unique(np.concatenate([h for h, _ in held]) if held else np.empty(0, np.uint64), return_inverse=True)
            yield from rows(block, signed(keys), np.bincount(each, np.concatenate([c for _, c in held]) if held else None, len(keys)).astype(float))

        for whole in batches:
            of = whole.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)] if len(of) else [0]
            for low, high in zip(edges, edges[1:], strict=False):
                if of[low] != block:
                    if held:
                        yield from told()
                    held, block = [], int(of[low])
                batch = whole.slice(low, high - low)
                train = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                parts, distinct, places = _distinct(filled(batch.column(0)))
                n = np.zeros(len(distinct), np.int64)
                for at, to, w, each in parts:
                    mine = np.repeat(train[at:to], w.n)
                    n += np.bincount(each[mine], minlength=len(distinct))
                ends += int(train.sum())
                for i, at, among in places:
                    live = n[among] > 0
                    w = parts[i][2]
                    for some, chars in by_length(w.body, w.start[at[live]], w.end[at[live]]):
                        Lattice(vocabulary, chars).expected(log_p, n[among[live]][some].astype(float), pieces)
                held.append((distinct, n))
        if held:
            yield from told()
        pieces[-1] = ends
        some = np.flatnonzero(pieces)
        yield from rows(-1, some, pieces[some])

    def summed(block: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        word = block >= 0  # a key's piece counts, if any, come before its words
        first = np.append(True, (key[1:] != key[:-1]) | (word[1:] != word[:-1]))
        starts = np.flatnonzero(first)
        sums = np.repeat(np.add.reduceat(n, starts), np.diff(np.append(starts, len(key))))
        out = word | first
        return pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (block, key, sums, word & first)], names=["block", "key", "n", "first"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by key and block; all that is carried on is the last key's rows."""
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy() for c in batch.columns[:3]]
            low = int(np.searchsorted(new[1], new[1][-1]))
            if low or held and held[-1][1][0] != new[1][0]:
                yield summed(*(np.concatenate(c) for c in zip(*held, [c[:low] for c in new], strict=True)))
                held = []
            held.append([c[low:].copy() for c in new])
        if held:
            yield summed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return mapped(mapped(docs, count, COUNTS).repartition("key").sortWithinPartitions("key", "block"), total, COUNTS)


def score(docs: DataFrame, *, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (A-Z lower-cased) and one end; rows with crc32(id as text)
    mod 5 = 1 are held out, all others train. ``base_score``: sum over tokens of
    log10((c + 0.5) / (N + 0.5 (V + 1))). ``score``: log10 of the marginal
    probability of the text and its end over all segmentations into pieces; byte
    pieces cover whatever the vocabulary lacks, so it is always finite. Null and
    empty texts are an end alone; a null id counts as an empty text and trains;
    repeated rows train and score each; with no training text N = V = 0; an
    empty table gives no rows; other columns are not looked at.

    Blocks are stretches of about ``BLOCK_BYTES`` of the input's partitions as
    first read, so that no task holds more, however large a partition; rows are
    written with their block's number, so that a later read, or one after a lost
    executor, finds the same blocks however the input is dealt.
    """
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.crc32(F.encode(text_id, "UTF-8")) % 5 == 1).alias("held_out"))
    base = written(numbered(base))
    counts = written(word_counts(base.select("text", "held_out", "block"), vocabulary_path))
    words = counts.filter("block >= 0")
    found = words.filter("first").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    vocabulary = Vocabulary.load(vocabulary_path)
    expected = np.zeros(len(vocabulary.start))
    for r in counts.filter("block = -1").groupBy("key").agg(F.sum("n").alias("n")).collect():  # a row per piece
        expected[r["key"]] = r["n"]
    weights = expected + PRIOR * vocabulary.start
    log_p = np.log(weights / weights.sum())
    ends = int(expected[-1])
    n_train, n_distinct = int(found["n"] or 0) + ends, int(found["v"]) + (ends > 0)
    floor = np.log10(n_train + 0.5 * (n_distinct + 1))
    learnt = docs.sparkSession.sparkContext.broadcast((np.append(log_p[:-1], -np.inf), log_p[-1]))  # a number per piece
    schema = T.StructType([base.schema["id"], T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        vocabulary = Vocabulary.load(vocabulary_path)
        log_p, log_end = learnt.value
        names = left.column_names
        texts = filled(left.column(names.index("text")))
        known = np.argsort(keys := right.column("key").to_numpy().view(np.uint64))
        keys, n = keys[known], right.column("n").to_numpy()[known]
        parts, distinct, places = _distinct(texts)
        at = np.minimum(np.searchsorted(keys, distinct), max(0, len(keys) - 1))
        if len(distinct) and (not len(keys) or (keys[at] != distinct).any()):
            raise RuntimeError("a block's words are not among its counts")
        c = n[at] if len(distinct) else np.empty(0)
        per_word = np.stack([np.log10(c + 0.5), (c > 0).astype(float), marginals(vocabulary, log_p, parts, len(distinct), places) / np.log(10)])
        sums = np.zeros((3, len(texts)))
        tokens = np.ones(len(texts), np.int64)
        for low, high, w, each in parts:
            tokens[low:high] += w.n
            for k in range(3):
                total = np.concatenate(([0.0], np.cumsum(per_word[k][each])))
                sums[k, low:high] = total[w.first[1:]] - total[w.first[:-1]]
        return pa.table([
            left.column(names.index("id")), left.column(names.index("held_out")), pa.array(tokens), pa.array(np.rint(sums[1]).astype(np.int64) + (ends > 0)),
            pa.array(np.full(len(texts), n_train)), pa.array(sums[0] + np.log10(ends + 0.5) - tokens * floor), pa.array(sums[2] + log_end / np.log(10)),
        ], names=schema.names)

    return base.groupBy("block").cogroup(words.select("block", "key", "n").groupBy("block")).applyInArrow(rate, schema)
