"""Hashes of words and of runs of words, computed over the bytes of whole Arrow batches.

A word is a run of bytes other than blank and \\x09 to \\x0D, with A-Z lower-cased unless the caller says otherwise. Its
hash is a polynomial over a random number for each byte, modulo 2**64, so prefix sums give all words of a batch at
once; texts are gone through in chunks of bounded size, and a word that a chunk cuts is put together again. No cache
of words is kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(of: int) -> np.ndarray:
    out = np.full(CHUNK + 1, of, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    def __init__(self):
        self.number = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
        self.lower = self.number.copy()
        self.lower[65:91] = self.lower[97:123]
        self.word = np.ones(256, bool)
        self.word[[9, 10, 11, 12, 13, 32]] = False
        self.power, self.inverse = (_powers(b) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


@functools.lru_cache(maxsize=1)
def _tables() -> _Tables:
    return _Tables()


def _chunk(data: np.ndarray, firsts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in at most CHUNK bytes, and their hashes; no word goes on over a place in ``firsts``."""
    t = _tables()
    word = t.word[data]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    inner = firsts[(firsts > 0) & (firsts < len(data))]
    begin[inner] = word[inner]
    stop[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((t.lower if lower else t.number)[data] * t.power[: len(data)], out=sums[1:])
    return starts, ends, (sums[ends] - sums[starts]) * t.inverse[starts]


def _long(data: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of the words of one text of any length."""
    out, held, size = [], 0, 0  # held, size: hash and bytes of a word that the last chunk cut
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        starts, ends, h = _chunk(part, np.empty(0, np.int64), lower)
        if size and (not len(starts) or starts[0] > 0):
            out.append(np.array([held], np.uint64))
            held = size = 0
        if len(starts) and size:
            h[0] = np.uint64((held + pow(_BASE, size, 1 << 64) * int(h[0])) & _MASK)
        if len(starts) and ends[-1] == len(part):
            size = int(ends[-1] - starts[-1]) + (size if len(starts) == 1 and starts[0] == 0 else 0)
            held = int(h[-1])
            h = h[:-1]
        else:
            held = size = 0
        out.append(h)
    if size:
        out.append(np.array([held], np.uint64))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes of some rows, where each of the rows starts in them and ends) over all rows of a column.

    Null texts have no words. Rows come together up to CHUNK bytes, longer ones by themselves. Without ``lower``, words
    that differ in the case of A-Z are different.
    """
    column = column.fill_null("").cast(pa.string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1)
        own = data[offsets[low] : offsets[high]]
        if len(own) > CHUNK:
            h = _long(own, lower)
            bounds = np.array([0, len(h)])
        else:
            firsts = offsets[low : high + 1] - offsets[low]
            starts, _, h = _chunk(own, firsts[:-1], lower) if len(own) else (np.empty(0, np.int64), None, np.empty(0, np.uint64))
            bounds = np.searchsorted(starts, firsts)
        yield low, mixed(h), bounds
        low = high


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; runs of different widths differ."""
    k = len(h) - width + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    out = h[:k] + np.uint64(width)
    for i in range(1, width):
        # The words' hashes are random numbers already: an odd factor for each place keeps their order apart.
        out *= _FACTOR
        out += h[i : k + i]
    return mixed(out)
