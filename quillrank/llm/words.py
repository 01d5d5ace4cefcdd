"""Vectorised words, word hashes and shingles over Arrow string arrays.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lowered, so
any byte above 0x7F belongs to a word. Word hashes come from one running sum
over the bytes (a polynomial modulo 2**64 over random byte values), so no
Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT, _SIZE = _rng.integers(1, 2**63, (2, 64), dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES)
        for at, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[at] = np.cumprod(table)
    return _powers


class Words:
    """The words of a run of texts.

    ``hashes``: one 64-bit value per word; ``doc``: the text each belongs to;
    ``counts``: words per text; ``start``/``end``: byte positions in ``data``
    (lower-cased bytes of all texts), ``edges``: byte offsets of the texts.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
        self.edges = offsets - offsets[0]
        self.raw = data
        self.data = data = _LOWER[data]
        size = len(data)
        inside = ~_SPACE[data]
        fresh = np.zeros(size + 1, bool)
        fresh[self.edges] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | fresh[1:size]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | fresh[1:size]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        up, down = _power_tables(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:size], out=sums[1:])
        self.hashes = mixed((sums[self.end] - sums[self.start]) * down[self.start])
        first = np.searchsorted(self.start, self.edges)
        self.first = first
        self.counts = np.diff(first)
        self.doc = np.repeat(np.arange(n), self.counts)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words and their number per text.

        A text with 1 to n-1 words has one shingle, its whole sequence; one
        without words has none. A short whole sequence is salted with its length.
        """
        w, counts = self.hashes, self.counts
        many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        if not len(w):
            return np.empty(0, np.uint64), many
        first, m = self.first[:-1], len(w)
        total = np.zeros(m, np.uint64)
        for k in range(min(n, m)):
            total[: m - k] += w[k:] * _STEP[k]
        keep = np.zeros(m + 1, np.int64)
        full = counts >= n
        np.add.at(keep, first[full], 1)
        np.add.at(keep, first[full] + counts[full] - n + 1, -1)
        good = np.cumsum(keep[:m]) > 0
        for d in np.flatnonzero((counts > 0) & ~full):
            own = w[first[d] : first[d] + counts[d]]
            total[first[d]] = (own * _STEP[: len(own)]).sum(dtype=np.uint64) ^ _SHORT[len(own)]
            good[first[d]] = True
        return mixed(total[good] ^ _SIZE[n]), many


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes (one text at least)."""
    texts = batch.column(column).cast(pa.large_string())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]) if len(texts) else []
    at = have = 0
    for i, size in enumerate(sizes):
        if i > at and have + size > most:
            yield batch.slice(at, i - at)
            at, have = i, 0
        have += size
    if at < len(texts):
        yield batch.slice(at)
