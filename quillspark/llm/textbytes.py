"""Texts as byte buffers: slices of Arrow string columns, words and their hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that a step works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) without copying; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


#: Word bytes: digits, letters and everything outside ASCII; A-Z fold to a-z.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[:128] = [chr(c).isalnum() for c in range(128)]
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_CACHE.get("up", ())) < n:
        m = max(n, SLICE_BYTES + 1)
        _CACHE["up"], _CACHE["down"] = _powers(MULTIPLIER, m), _powers(_INVERSE, m)
    return _CACHE["up"], _CACHE["down"]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of every word, in order; words never cross rows."""
    inside = WORD_BYTE[data]
    edge = np.zeros(len(data) + 1, bool)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
    starts_at = edge.copy()
    starts_at[:-1] &= inside
    starts_at[-1:] = False
    ends_at = edge.copy()
    ends_at[1:] &= inside
    ends_at[:1] = False
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[inside[inner] & inside[inner - 1]]
    starts_at[cut] = True
    ends_at[cut] = True
    start, end = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[FOLD[data]] * up[: len(data)], out=total[1:])
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, "right") - 1
    return h, start, end, row


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of its first word) of every run of ``n`` words of a row; a row of fewer words has the run of them all."""
    counts = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(len(h))
    keep = at + n <= first[row + 1]
    out = mixed(h + np.uint64(1))
    for k in range(1, n):
        out[: max(0, len(h) - k)] += mixed(h[k:] + np.uint64(k + 1))
    value, rows, at = mixed(out[keep]), row[keep], at[keep]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        each = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            each[has] += mixed(h[first[short[has]] + k] + np.uint64(k + 1))
        value, rows, at = np.concatenate([value, mixed(each)]), np.concatenate([rows, short]), np.concatenate([at, first[short]])
        order = np.argsort(rows, kind="stable")
        value, rows, at = value[order], rows[order], at[order]
    return value, rows, at
