"""Vectorised byte and token kernels over Arrow batches (numpy only, no per-word Python work)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer single text is handled alone.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C13 | 3  # odd, and 3 modulo 8
_BASE = (_BASE & ~7) | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:  # doubling: out[done:2*done] = out[:done] * base**done
            step = min(done, size - done)
            out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have = out
        if size > 4 * CHUNK_BYTES:
            _powers[base] = out[: 4 * CHUNK_BYTES].copy()
    return have[:n]


def released(run):
    """``run`` (batches to batches), after which the worker gives memory that it has freed back to the system.

    Workers wait for the next task; what the last one left in their allocators would count until then.
    """

    def kernel(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return kernel


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (xor-shift-multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of code(data[j]) * B**j over j < i, modulo 2**64."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE_CODES[data] * _power_table(_BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends], equal for equal strings wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * _power_table(_INVERSE, len(prefix))[starts] + (ends - starts).astype(np.uint64))


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` bytes, by start."""
    n = len(prefix) - width
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((prefix[width:] - prefix[:-width]) * _power_table(_INVERSE, n))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets with one more entry than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) with at most ``limit`` bytes unless a single row is longer."""
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... for each i, joined."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, l = starts[full].astype(np.int64), lengths[full].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(l)[:-1]])
    out[first] = s
    out[first[1:]] -= s[:-1] + l[:-1] - 1
    return np.cumsum(out)


_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row with one more entry than rows): maximal runs without ASCII white space."""
    inside = _WORD_BYTE[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)
