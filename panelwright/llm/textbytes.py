"""Vectorised word and n-gram hashing over the UTF-8 buffers of Arrow string columns.

Every function works on a *chunk*: the bytes of some whole texts laid end to end, with their offsets.
Hashes are 64-bit and depend on content alone, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Chunks hold whole texts of about this many bytes together; a longer text is a chunk alone.
CHUNK_BYTES = 1 << 19
#: The C library's own way to give back what was freed, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, P, P^2 ... modulo 2^64 (or of P's inverse), at least n of them."""
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = pow(_P, -1, 1 << 64) if inverse else _P
        have = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    size = np.dtype(kind).itemsize
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * size).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts."""
    raw, off = text_buffer(column)
    first, rows = 0, len(off) - 1
    while first < rows:
        end = int(np.searchsorted(off, off[first] + limit, "right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, raw[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end
    release()


def release() -> None:
    """Hand freed memory back to the machine, as workers stay for further tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def byte_class(keep: str) -> np.ndarray:
    """Which bytes belong to words. ``space``: all but 0x20 and 0x09-0x0D. ``alnum``: 0-9, a-z and bytes from 0x80 (after lower-casing)."""
    out = np.ones(256, bool)
    if keep == "space":
        out[0x20] = False
        out[0x09:0x0E] = False
    else:
        out[0x00:0x30] = False
        out[0x3A:0x61] = False
        out[0x7B:0x80] = False
        out[0x41:0x5B] = True  # upper case counts as lower case
    return out


@lru_cache(maxsize=2)
def _tables(keep: str) -> tuple[np.ndarray, np.ndarray]:
    inside, values = byte_class(keep), _byte_values().copy()
    values[0x41:0x5B] = values[0x61:0x7B]
    values[~inside] = 0
    return inside, values


def words(raw: np.ndarray, off: np.ndarray, keep: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte and text index of every word of a chunk, in order; A-Z hash as a-z."""
    if not len(raw):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside, values = _tables(keep)
    m = inside[raw]
    begins = m.copy()
    begins[1:] &= ~m[:-1]
    edges = off[:-1][off[:-1] < len(raw)]
    begins[edges] = m[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U), starts, starts
    h = np.add.reduceat(values[raw] * powers(len(raw)), starts)
    h = mix(h * powers(len(raw), True)[starts])
    return h, starts, np.searchsorted(off, starts, "right") - 1


def word_sizes(raw: np.ndarray, off: np.ndarray, starts: np.ndarray, keep: str) -> np.ndarray:
    """Bytes of the words that begin at ``starts``."""
    stops = np.union1d(np.flatnonzero(~_tables(keep)[0][raw]), off[1:])
    return stops[np.searchsorted(stops, starts, "right")] - starts


def prefixes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int, keep: str) -> tuple[np.ndarray, np.ndarray]:
    """Which words have over n bytes, and the hash of their first n."""
    which = np.flatnonzero(sizes > n)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(_tables(keep)[1][raw] * powers(len(raw)), out=total[1:])
    at = starts[which]
    return which, mix((total[at + n] - total[at]) * powers(len(raw) + 1, True)[at] + U(n))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by the first one's place (len(h) - k + 1 of them)."""
    if len(h) < k:
        return np.zeros(0, U)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= U(_P)
        out += h[j : j + n]
    return mix(out)


def sliding(f: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """f (np.minimum or np.maximum) over each w consecutive values."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while have * 2 <= w:
        out, have = f(out[:-have], out[have:]), have * 2
    return f(out[: len(out) - (w - have)], out[w - have :]) if have < w else out


def window_minima(g: np.ndarray, w: int) -> np.ndarray:
    """Places that hold the smallest value of some w consecutive values (all places of a tie)."""
    if len(g) < w:
        return np.zeros(0, np.int64)
    least = sliding(np.minimum, g, w)
    # the largest of the minima of the windows over a place equals the value there just if it is one of them
    padded = np.concatenate([np.zeros(w - 1, g.dtype), least, np.zeros(w - 1, g.dtype)])
    return np.flatnonzero(sliding(np.maximum, padded, w) == g)
