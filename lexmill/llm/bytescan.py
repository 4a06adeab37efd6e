"""Vectorised scans over the UTF-8 bytes of Arrow string columns.

Words, shingles and windows are found and hashed with numpy over blocks of
whole documents, so that no Python code runs per word. A word's hash is a
polynomial over random 64-bit codes of its bytes (mod 2**64), finished with a
mixing function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_CODES = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of a block; a longer document is a block of its own.
BLOCK = 1 << 20

#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*outside: tuple[int, int]) -> np.ndarray:
    """A table that is False for bytes in one of the closed ranges `outside`."""
    table = np.ones(256, bool)
    for a, b in outside:
        table[a : b + 1] = False
    return table


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept while small."""
    have = _powers.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    size = max(n, BLOCK + 1)
    out = np.full(size, base, U64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if size <= 4 * BLOCK:
        _powers[base] = out
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash: n + 1 values, for range_hash."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(_CODES[buf] * powers(_BASE, len(buf)), out=out[1:])
    return out


def range_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end] that don't depend on the place."""
    return mix((running[end] - running[start]) * powers(_INVERSE, len(running))[start])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges i..j of at most `limit` bytes (or one row), their bytes and offsets."""
    buf, offs = utf8(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes in the class, and n + 1 offsets of each document's runs."""
    mask = np.zeros(len(buf) + 2, bool)
    mask[1:-1] = inside[buf]
    first = mask[1:-1] & ~mask[:-2]
    last = mask[1:-1] & ~mask[2:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    first[cuts] = mask[1:-1][cuts]
    last[cuts - 1] = mask[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and n + 1 offsets of each document's words."""
    starts, ends, at = words(buf, offs, inside)
    return range_hash(prefix_hash(buf), starts, ends), at
