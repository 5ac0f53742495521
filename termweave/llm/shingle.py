"""Vectorised word hashing over Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, step in enumerate((_STEP, np.uint64(pow(int(_STEP), -1, 1 << 64)))):
            x = np.full(size, step, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about limit bytes; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each text and one past the last)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SEP[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(column, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles as 64-bit hashes; fewer words: the whole sequence as one."""
    return (s for _, s in counted_sets(column, k))


def counted_sets(column, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, set) of each text, see shingle_sets."""
    m = [np.uint64(pow(0xD6E8FEB86659FD93, i, 1 << 64)) for i in range(k + 1)]
    for _, data, offsets in chunks(column):
        h, at = words(data, offsets)
        n = max(0, len(h) - k + 1)
        s = np.full(n, k * int(m[k]) % (1 << 64), np.uint64)
        for i in range(k):
            s += h[i : i + n] * m[i]
        s = mixed(s)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                x = np.sort(s[a : b - k + 1])
                yield b - a, x if len(x) < 2 else x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif b > a:
                one = np.array([(b - a) * int(m[k]) % (1 << 64)], np.uint64)
                for i in range(b - a):
                    one += h[a + i : a + i + 1] * m[i]
                yield b - a, mixed(one)
            else:
                yield 0, np.zeros(0, np.uint64)
