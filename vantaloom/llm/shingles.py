"""Word-shingle hashes of whole Arrow batches, in numpy.

A word is a run of bytes other than space and tab to carriage return; A-Z count as
a-z. A word's hash sums a random number for each byte times a power of an odd base,
mod 2**64, and is mixed with its length; a shingle's hash mixes those of its words in
order. Two different shingles agree by chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
_rng = np.random.default_rng(20240229)
_odd = lambda n: _rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE, _BASE, _PLACE, _SHORT = _odd(256), _odd(1)[0], _odd(WIDTH), _odd(WIDTH)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: a public 64-bit finaliser
PIECE = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base, and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            more = max(n, PIECE + 1) - 1
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(more, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(more, self.inverse)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _hash_piece(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; document d lies before ends[d]."""
    n, n_docs = len(data), len(ends)
    if not n:
        return [np.zeros(0, dtype=np.uint64)] * n_docs
    begins = np.concatenate([[0], ends[:-1]])
    word = ~_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[begins] = True
    first[ends] = True
    starts = np.flatnonzero(word & np.concatenate([[True], ~word[:-1] | first[1:n]]))
    stops = np.flatnonzero(word & np.concatenate([~word[1:] | first[1:n], [True]])) + 1
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64)] * n_docs
    up, down = _powers.to(n)
    values = _VALUE[data] * up
    edges = np.column_stack([starts, stops]).reshape(-1)
    sums = np.add.reduceat(np.append(values, np.uint64(0)), edges)[::2]
    words = mix(sums * down[starts] + (stops - starts).astype(np.uint64) * _M2)
    per_doc = np.searchsorted(starts, ends) - np.searchsorted(starts, begins)
    at = np.concatenate([[0], np.cumsum(per_doc)])
    full = mix(sum((words[k : len(words) - WIDTH + 1 + k] * _PLACE[k] for k in range(WIDTH)), np.zeros(max(0, len(words) - WIDTH + 1), dtype=np.uint64))) if len(words) >= WIDTH else words[:0]
    out = []
    for d in range(n_docs):
        a, k = int(at[d]), int(per_doc[d])
        if k >= WIDTH:
            own = np.sort(full[a : a + k - WIDTH + 1])
            out.append(own if k == WIDTH else own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif k:
            h = mix((words[a : a + k] * _PLACE[:k]).sum(dtype=np.uint64, keepdims=True) + _SHORT[k - 1])
            out.append(h)
        else:
            out.append(words[:0])
    return out


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text, in order; null texts have the empty set. Memory follows PIECE bytes, or the longest text."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
            yield from _hash_piece(data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i])
            i = j
