"""Vectorised word splitting and hashing over the UTF-8 bytes of an Arrow string column.

Texts are handled in chunks of whole documents, so memory follows `CHUNK` (or the longest
single document), never the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
#: bytes of text after which a worker gives freed memory back
RELEASE = 16 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_pow = _ipow = np.ones(1, U)
_since = 0

#: bytes lower-cased for A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IDENTITY = np.arange(256, dtype=np.uint8)
#: every byte but ASCII white space (space, tab to carriage return)
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, *range(9, 14)]] = False
#: digits, lower-case letters and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection, so equal inputs and only those give equal outputs."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def release(used: int) -> None:
    """Hand freed memory back to the system, once for every `RELEASE` bytes of text: workers outlive
    their tasks, and what the allocators keep counts against the executor. Nothing where the C
    library has no such call.
    """
    global _since
    _since += used
    if _since >= RELEASE:
        _since = 0
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            return


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = 1 << max(19, n.bit_length())
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _pow, _ipow = made
    return _pow, _ipow


@dataclass
class Words:
    """Words of a run of documents: byte bounds in `data`, hashes, and each document's first word."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    doc_start: np.ndarray
    prefix: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes [start, end), the same wherever they stand."""
        h = (self.prefix[end] - self.prefix[start]) * _powers(len(self.data) + 1)[1][start]
        return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    @property
    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about `size` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, broken at the inner bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = bounds[(bounds > 0) & (bounds < n)]
    before[cut] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(column, inside: np.ndarray, fold: np.ndarray = LOWER, size: int = CHUNK) -> Iterator[Words]:
    raw, offsets = text_bytes(column)
    for lo, hi in pieces(offsets, size):
        data = fold[raw[offsets[lo] : offsets[hi]]]
        at = offsets[lo : hi + 1] - offsets[lo]
        start, end = runs(inside[data], at)
        first = np.searchsorted(start, at)
        prefix = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * _powers(len(data) + 1)[0][: len(data)], out=prefix[1:])
        yield Words(lo, hi, data, start, end, first, at, prefix)
        release(len(data))


def ngram_sets(w: Words, n: int, inside_hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of each document and their offsets.

    A document of fewer words has its whole sequence as the only shingle; one without words has none.
    """
    h = w.hashes if inside_hashes is None else inside_hashes
    counts = w.counts
    total = len(h)
    acc = h.copy()
    for j in range(1, n):
        acc[: total - j] = acc[: total - j] * U(0x9FB21C651E98DF25) + h[j:] if total > j else acc[: total - j]
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    keep = np.zeros(total, bool)
    within = np.arange(total) - np.repeat(w.first[:-1], counts)
    keep[within < np.repeat(made, counts)] = True
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        part, value = h[w.first[d] : w.first[d + 1]], U(int(counts[d]))
        for x in part:
            value = value * U(0x9FB21C651E98DF25) + x if isinstance(value, np.ndarray) else (np.array([value]) * U(0x9FB21C651E98DF25) + x)
        acc[w.first[d]] = value[0]
    return distinct(mix(acc[keep]), offsets)


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort and deduplicate within each [offsets[i], offsets[i+1])."""
    values = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[offsets[:-1][np.diff(offsets) > 0]] = True
    return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[offsets]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
