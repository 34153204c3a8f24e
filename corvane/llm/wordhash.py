"""Words of many texts at once: positions and 64-bit hashes by numpy over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in slices of about so many bytes, which bounds memory at some 40 bytes a byte; one longer text is a slice of its own.
SLICE = 1 << 20

_U = np.uint64
_R = 0x9E3779B97F4A7C15  # an odd multiplier; its inverse modulo 2^64 exists
_RINV = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, _U)
    p[:1] = 1
    return np.multiply.accumulate(p)


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of a string column; null counts as empty."""
    column = column.fill_null("")
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges start..end."""
    n = len(data)
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(_R, n), out=total[1:])
    h = (total[end] - total[start]) * powers(_RINV, n + 1)[start]
    return mix(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of the words [^\\x20\\x09-\\x0D]+; words of text i are first[i]:first[i + 1]."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    opens, closes = step == 1, step == -1
    cut = offsets[1:-1]  # a word ends where its text does
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    opens[cut] = closes[cut] = True
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    return start, end, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, first) of the words, as bounds() finds them; lower: hashes of a-z for A-Z."""
    start, end, first = bounds(data, offsets)
    return start, end, hashes(_LOWER[data] if lower else data, start, end), first


_MULT = [int(m) | 1 for m in np.random.RandomState(7).randint(1, 2**62, 64, dtype=np.int64)]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), _U)
    for i in range(k if n > 0 else 0):
        out += h[i : i + n] * _U(_MULT[i])
    return mix(out)
