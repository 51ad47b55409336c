"""Vectorised word and shingle arithmetic over Arrow text columns.

Everything here works on the UTF-8 bytes of a whole batch at once; words are the maximal runs of bytes
outside space and 0x09-0x0D, so multi-byte characters are never split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, np.uint64)
WORD_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        out = np.full(max(n, 2 * len(_POW)), _BASE & 0xFFFFFFFFFFFFFFFF, np.uint64)
        out[0] = 1
        _POW = np.multiply.accumulate(out)
    return _POW


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after the other, and the rows' offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(offs) and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0] if len(offs) else np.zeros(1, np.int64)


def slices(offs: np.ndarray, limit: int):
    """Row ranges of at most `limit` bytes each; one longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def is_space(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and row of every word."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~is_space(buf)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offs[:-1][offs[:-1] < offs[1:]]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges[1:] - 1] = inside[edges[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each of the disjoint, ordered, non-empty spans."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    taken = buf[at + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)
    taken *= _powers(int(size.max()))[at]
    return mix(np.add.reduceat(taken, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf)


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words within a row; a row with 1 to k-1 words has its whole sequence as one.

    The result is ordered by row.
    """
    per = np.bincount(row, minlength=n_rows)
    n = len(hashes)
    steps = WORD_STEPS[:k]
    head = np.zeros(0, np.int64)
    values = np.zeros(0, np.uint64)
    if n >= k:
        head = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
        values = np.full(len(head), k, np.uint64)
        for i in range(k):
            values += mix(hashes[head + i] + np.uint64(i)) * steps[i]
        values = mix(values)
    short = np.flatnonzero((per > 0) & (per < k))
    if not len(short):
        return values, row[head]
    first = np.cumsum(per) - per
    extra = per[short].astype(np.uint64)
    for i in range(k - 1):
        has = per[short] > i
        extra[has] += mix(hashes[first[short[has]] + i] + np.uint64(i)) * steps[i]
    values, rows = np.concatenate([values, mix(extra)]), np.concatenate([row[head], short])
    order = np.argsort(rows, kind="stable")
    return values[order], rows[order]


def distinct_by_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row one after the other, and the rows' offsets."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[keep], rows[keep]
    return values, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))]).astype(np.int64)
