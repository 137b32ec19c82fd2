"""Byte-level BPE ids of many texts at once.

A byte-level pre-tokeniser never joins what stands before a lone blank with
what follows, nor a lone line feed with what follows, nor an ASCII letter with
a comma or full stop. So a text's ids are those of its chunks, cut at these
places. Each distinct chunk is encoded once; the ids are then laid out by numpy.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from talweg.llm.words import BLANK, Words, slices

#: Distinct chunks that a worker remembers; it forgets them all beyond that.
REMEMBERED = 500_000
SPECIAL = "<|endoftext|>"
#: Whether a byte is an ASCII letter; whether it is a comma or full stop.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_loaded: dict[tuple[str, str | None], Encoder] = {}


class Encoder:
    """Ids as ``tokenizers`` gives them; ``ranks_path`` names the same vocabulary as ranks, which is faster."""

    def __init__(self, path: str, ranks_path: str | None):
        self._path, self._exact = path, None
        self._known: dict[int, bytes] = {}
        self._plain = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._plain = tiktoken.Encoding(ranks_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def exact(self, text: str) -> list[int]:
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self._path)
        return self._exact.encode(text, add_special_tokens=False).ids

    def chunk(self, text: str) -> bytes:
        return array("I", self._plain(text) if SPECIAL not in text else self.exact(text)).tobytes()

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each slice: its first row, all its ids and each text's offsets into them."""
        for at, to in slices(texts):
            part = texts.slice(at, to - at)
            if self._plain is None:
                found = [self.exact(x) for x in part.to_pylist()]
                yield at, np.fromiter(chain.from_iterable(found), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
                continue
            w = Words(part, BLANK, fold=False)
            lone = np.ones(len(w.start), bool)
            lone[1:] = w.start[1:] - w.end[:-1] == 1
            lone[w.first[:-1][w.n > 0]] = False  # a text's first word: its chunk starts with the text
            cut = np.zeros(len(w.body) + 1, bool)
            cut[1:-1] = _STOP[w.body[1:]] & _LETTER[w.body[:-1]]
            cut[w.start[lone] - 1] = True
            feeds = w.start[lone]
            cut[feeds[w.body[feeds - 1] == 0x0A]] = True
            cut[w.off] = True
            start = np.flatnonzero(cut[:-1])
            if not len(start):
                yield at, np.empty(0, np.uint32), np.zeros(to - at + 1, np.int64)
                continue
            first = np.searchsorted(start, w.off)
            end = np.append(start[1:], len(w.body))
            hashes, one, each = np.unique(w.spans(start, end), return_index=True, return_inverse=True)
            body, known = w.body.tobytes(), self._known
            if len(known) > REMEMBERED:
                known.clear()
            found = []
            for h, a, b in zip(hashes.tolist(), start[one].tolist(), end[one].tolist(), strict=True):
                got = known.get(h)
                if got is None:
                    got = known[h] = self.chunk(body[a:b].decode())
                found.append(got)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat = np.frombuffer(b"".join(found), np.uint32)
            lead = np.cumsum(sizes) - sizes
            n = sizes[each]
            ends = np.cumsum(n)
            ids = flat[np.arange(ends[-1]) + np.repeat(lead[each] - (ends - n), n)]
            yield at, ids, np.concatenate(([0], ends))[first]


def encoder(path: str, ranks_path: str | None = None) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = (path, ranks_path)
    if key not in _loaded:
        _loaded[key] = Encoder(path, ranks_path)
    return _loaded[key]
