"""Vectorised word scanning over Arrow string columns.

A slice of texts is viewed as one byte buffer; words, their 64-bit hashes and
rolling k-word hashes come from a handful of numpy passes, with no per-word
Python. Slices are kept near ``SLICE_BYTES`` so that temporaries stay small;
one text longer than that is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_MASK = (1 << 64) - 1
_BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_codes(fold: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


FOLDED, EXACT = _byte_codes(True), _byte_codes(False)

#: Bytes that end a word: space and 0x09-0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end an alphanumeric word once A-Z is folded: all ASCII but 0-9, A-Z, a-z.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    NOT_ALNUM[_a:_b] = False

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 4096)
        got = np.empty(size, np.uint64)
        got[0] = 1
        done = 1
        while done < size:  # doubling: p[i + done] = p[i] * base**done
            step = min(done, size - done)
            got[done : done + step] = got[:step] * np.uint64(pow(int(base), done, 1 << 64))
            done += step
        if size <= 4 * SLICE_BYTES:
            _powers[kind] = got
    return got[:n]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    n = len(texts)
    if not n:
        return
    off = offsets(texts)
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def parts(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """A batch in batches of at most ``rows`` rows, so that whoever reads them holds no more at a time."""
    for at in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(at, rows)


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One Arrow array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    return column


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice and each text's offsets into them."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = offsets(texts)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return body, off - off[0]


class Words:
    """Words of a slice of texts.

    ``start``/``end``: byte ranges in ``body``; ``first``: each text's first
    word, and the number of words as a last entry; ``hash``: a 64-bit hash of
    each word, with A-Z folded unless ``fold`` is off.
    """

    def __init__(self, texts: pa.Array, breaks: np.ndarray = BLANK, fold: bool = True):
        self.body, self.off = raw(texts)
        body, off = self.body, self.off
        inside = ~breaks[body]
        n = len(body)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            before &= ~edge[:-1]
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
            after &= ~edge[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.n = np.diff(self.first)
        self._fold = fold
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.spans(self.start, self.end)
        return self._hash

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes (A-Z folded unless ``fold`` is off) have equal hashes."""
        n = len(self.body)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        codes = (FOLDED if self._fold else EXACT)[self.body]
        codes *= _power("up", BASE, n)
        np.cumsum(codes, out=total[1:])
        h = total[end] - total[start]
        h *= _power("down", _BASE_INV, n + 1)[start]
        return mix(h)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each run of k words and each text's first one (runs never cross texts)."""
        h = self.hash
        counts = np.maximum(self.n - k + 1, 0)
        first = np.concatenate(([0], np.cumsum(counts)))
        if not first[-1]:
            return np.empty(0, np.uint64), first
        m = len(h) - k + 1
        total = gram_sum(h, k)
        keep = np.zeros(len(h) + 1, np.int32)
        live = counts > 0
        np.add.at(keep, self.first[:-1][live], 1)
        np.add.at(keep, self.first[:-1][live] + counts[live], -1)
        return mix(total[np.cumsum(keep[:m]) > 0]), first


def gram_sum(h: np.ndarray, k: int) -> np.ndarray:
    """Unfinished k-run hashes: sum of hash[i + j] times a constant of j."""
    m = len(h) - k + 1
    total = np.zeros(m, np.uint64)
    for j in range(k):
        total += h[j : j + m] * np.uint64((0xA24BAED4963EE407 * pow(0x9FB21C651E98DF25, j, 1 << 64)) & _MASK)
    return total


def sequence_hash(h: np.ndarray) -> int:
    """The hash of a whole word sequence, as a run of its own length."""
    return int(mix(gram_sum(h, len(h)))[0])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return x.view(np.int64)
