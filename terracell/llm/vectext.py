"""Vectorised word handling over the raw UTF-8 buffers of Arrow string columns.

Every function works on whole batches with numpy, so the cost per word is a few
array passes instead of a Python call.  Words are identified by a 64-bit
polynomial fingerprint of their bytes; sequences of words by a polynomial over
the word fingerprints.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled by one numpy pass; keeps the 8-byte work arrays small.
PIECE_BYTES = 1 << 20
#: Bytes of text gathered into one chunk of documents.
CHUNK_BYTES = 4 << 20

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


try:
    _trim = ctypes.CDLL(None).malloc_trim
except AttributeError:  # not the GNU C library
    _trim = None


def give_back() -> None:
    """Returns freed memory to the system; workers live on between tasks and would hold what their largest task needed."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving memory back at the end of each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(_BYTE_BASE))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))

            def powers(b: int) -> np.ndarray:
                x = np.full(n, b, U64)
                x[0] = 1
                return np.multiply.accumulate(x)

            self.up, self.down = powers(self.base), powers(self.inverse)
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def space_table() -> np.ndarray:
    """True for bytes of words in the sense of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for bytes of words in the sense of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z is lower-cased."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


def fold_table() -> np.ndarray:
    """Byte map that lower-cases A-Z and nothing else."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of ``column``, one row at least."""
    _, offsets = text_buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a chunk of documents.

    start, end: byte positions in the chunk; code: 64-bit fingerprints;
    first: for each document the index of its first word, with the total last.
    """

    __slots__ = ("start", "end", "code", "first")

    def __init__(self, start, end, code, first):
        self.start, self.end, self.code, self.first = start, end, code, first

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def run_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of the byte runs ``data[start:end]``, which must be ordered and disjoint."""
    code = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        lo = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, lo + PIECE_BYTES, "right")))
        hi = int(end[to - 1])
        part = data[lo:hi] if fold is None else fold[data[lo:hi]]
        up, down = _BYTE_POWERS.upto(hi - lo + 1)
        total = np.empty(hi - lo + 1, U64)
        total[0] = 0
        np.cumsum(_BYTE_CODE[part] * up[: hi - lo], out=total[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        code[at:to] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        at = to
    return code


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Maximal runs of word bytes inside each document."""
    n = len(data)
    inside = is_word[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    code = run_codes(data, start, end, fold)
    return Words(start, end, code, first)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, fingerprint) of every run of ``k`` words inside one document."""
    n = len(w.code)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    per = np.maximum(w.counts() - k + 1, 0)
    skip = np.repeat(w.first[:-1] - np.concatenate(([0], np.cumsum(per)[:-1])), per)
    at = np.arange(int(per.sum())) + skip
    up, down = _WORD_POWERS.upto(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(w.code * up[:n], out=total[1:])
    return at, mix64((total[at + k] - total[at]) * down[at])
