"""Vectorised words, hashes, shingles and windows over Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+``. All separators are single ASCII bytes, so the work is done on UTF-8
bytes. Hashes are 64 bits, the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Text bytes worked on at a time; a longer document is one piece of its own.
CHUNK = 1 << 18
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Free memory of this worker, which lives on for other tasks, goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``run``, and when its task ends ``give_back``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))
        return self.up[:n], self.down[:n]


_AT_BYTE, _AT_WORD, _AT_WORD2 = (_Powers(int(b) | 1) for b in _RNG.integers(1 << 62, 2**64, 3, dtype=np.uint64))


@dataclass
class Words:
    """The words of some documents: byte ranges in ``data``; document i has words first[i]:first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        up, down = _AT_BYTE(max(1, len(self.data)))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, body = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body else np.zeros(0, np.uint8)
    return data, at - at[0]


def split(data: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    inside = ~_SEPARATES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # words end with their document
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at))


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``size`` text bytes: (rows, bytes, offsets)."""
    data, at = text_bytes(batch.column(text))
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield batch.slice(row, stop - row), data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def _starts(first: np.ndarray, k: int) -> np.ndarray:
    """True for words that start k consecutive words of one document."""
    ok = np.ones(first[-1], bool)
    for j in range(1, k):
        at = first[1:] - j
        ok[at[at >= first[:-1]]] = False
    return ok


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their offsets by document; a shorter document is one shingle."""
    n = len(h)
    total = np.zeros(n, np.uint64)
    up, _ = _AT_WORD(k + 1)
    for j in range(min(k, n)):
        total[: n - j] += h[j:] * up[j]
    ok = _starts(first, k)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        at = first[short]
        whole = np.zeros(len(short), np.uint64)
        for j in range(k):
            has = counts[short] > j
            whole[has] += h[at[has] + j] * up[j]
        total[at] = whole + counts[short].astype(np.uint64) * GOLDEN
        ok[at] = True
    below = np.zeros(n + 1, np.int64)
    np.cumsum(ok, out=below[1:])
    return mix(total[ok]), below[first]


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's hashes sorted and without repeats."""
    h = h.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[first[:-1][first[:-1] < first[1:]]] = True
    below = np.zeros(len(h) + 1, np.int64)
    np.cumsum(keep, out=below[1:])
    return h[keep], below[first]


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, hash, second hash) of every k-word window inside a document."""
    at = np.flatnonzero(_starts(first, k))
    at = at[at + k <= len(h)]
    out = []
    for powers in (_AT_WORD, _AT_WORD2):
        up, down = powers(max(1, len(h)))
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=total[1:])
        out.append(mix((total[at + k] - total[at]) * down[at]))
    return at, out[0], out[1]


def sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of h[i : i + k] for every i at which k values are left."""
    n = len(h)
    if n < k:
        return h[:0]
    size = -(-n // k) * k
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, k)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - k + 1], ahead[k - 1 : n])


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space, as (bytes, offsets)."""
    size = np.where(keep, words.ends - words.starts + 1, 0)
    total = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    bounds = total[words.first]
    out = np.full(total[-1] + 1, 0x20, np.uint8)
    starts, ends, to = words.starts[keep], words.ends[keep], total[:-1][keep]
    lengths = ends - starts
    if len(starts):
        before = np.cumsum(lengths) - lengths
        step = np.arange(int(lengths.sum()))
        out[step + np.repeat(to - before, lengths)] = words.data[step + np.repeat(starts - before, lengths)]
    # a document's text leaves out its last space
    drop = np.zeros(total[-1] + 1, bool)
    full = bounds[1:] > bounds[:-1]
    drop[bounds[1:][full] - 1] = True
    drop[-1] = True
    return out[~drop], bounds - np.concatenate([[0], np.cumsum(full)])


def string_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A string column from (bytes, offsets)."""
    if at[-1] >= 1 << 31:
        raise ValueError("over 2 GB of text in one piece")
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
