"""Two readings of one text, word by word: which words stay and which stand for which, at the least number of edits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a table of costs; readings that would need more are cut in two first, so that memory is linear in their words.
CELLS = 1 << 22
_FAR = 1 << 30


def _row(before: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    """The costs up to one more word of the first reading, given those before it."""
    best = before + 1
    np.minimum(best[1:], before[:-1] + (b != a), out=best[1:])
    place = np.arange(len(best))
    return np.minimum.accumulate(best - place) + place


def _halved(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A place in each reading that a cheapest alignment goes through."""
    middle = len(a) // 2
    ahead = back = np.arange(len(b) + 1)
    for x in a[:middle]:
        ahead = _row(ahead, x, b)
    for x in a[middle:][::-1]:
        back = _row(back, x, b[::-1])
    return middle, int(np.argmin(ahead + back[::-1]))


def _banded(a: np.ndarray, b: np.ndarray, t: int) -> list[tuple[int, int]] | None:
    """Words that stay, by a table of the cells within ``t`` of the diagonal; None if that many edits aren't enough."""
    n, m = len(a), len(b)
    cost = np.full((n + 1, 2 * t + 2), _FAR, np.int64)  # the last column stays out of reach
    off, place = np.arange(-t, t + 1), np.arange(2 * t + 1)
    wide = np.full(n + m + 2 * t + 2, -1, np.int64)
    wide[t + 1 : t + 1 + m] = b  # word k of the second reading, from 1, is at k + t
    cost[0, :-1] = np.where((off >= 0) & (off <= m), off, _FAR)
    for i in range(1, n + 1):
        same = wide[i : i + 2 * t + 1] == a[i - 1]
        best = np.minimum(cost[i - 1, :-1] + ~same, cost[i - 1, 1:] + 1)
        k = i + off
        best[k < 0] = _FAR
        best = np.minimum.accumulate(best - place) + place
        cost[i, :-1] = np.where((k >= 0) & (k <= m), best, _FAR)
    if cost[n, m - n + t] > t:
        return None
    kept, i, k = [], n, m
    while i and k:
        c, here = k - i + t, cost[i, k - i + t]
        if here == cost[i - 1, c] + (a[i - 1] != b[k - 1]):
            i, k = i - 1, k - 1
            if a[i] == b[k]:
                kept.append((i, k))
        elif here == cost[i - 1, c + 1] + 1:
            i -= 1
        else:
            k -= 1
    return kept[::-1]


def kept_words(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> list[tuple[int, int]]:
    """Places (in a, in b) of the words that a cheapest alignment leaves as they are; words are numbers from 0.

    Ends that are alike stay. A band around the diagonal is widened until the edits fit into it.
    """
    out, todo = [], [(a, b, 0, 0)]
    while todo:
        a, b, i, k = todo.pop()
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        head = int(differ[0]) if len(differ) else n
        out += zip(range(i, i + head), range(k, k + head), strict=True)
        a, b, i, k, n = a[head:], b[head:], i + head, k + head, n - head
        differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
        tail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        out += zip(range(i + len(a), i + len(a) + tail), range(k + len(b), k + len(b) + tail), strict=True)
        if not len(a) or not len(b):
            continue
        t = max(8, abs(len(a) - len(b)))
        while (len(a) + 1) * (2 * t + 2) <= cells or len(a) == 1:
            found = _banded(a, b, t)
            if found is not None:
                out += [(i + x, k + y) for x, y in found]
                break
            t *= 2
        else:
            x, y = _halved(a, b)
            todo += [(a[:x], b[:y], i, k), (a[x:], b[y:], i + x, k + y)]
    return sorted(out)


def blocks(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> list[tuple[int, int, int, int]]:
    """(i, j, k, m): a[i:j] stands where the other reading has b[k:m]; all that lies between words that stay."""
    out, i, k = [], 0, 0
    for x, y in [*kept_words(a, b, cells), (len(a), len(b))]:
        if x > i or y > k:
            out.append((i, x, k, y))
        i, k = x + 1, y + 1
    return out


_BLOCK = T.StructType([T.StructField(c, T.IntegerType()) for c in ("first", "last", "from", "until")])


#: Words up to which a reading is aligned together with others of as many.
SHORT = 64


def _alike(*keys: np.ndarray) -> list[np.ndarray]:
    """Places of equal keys."""
    order = np.lexsort(keys)
    new = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
    return np.split(order, np.flatnonzero(new) + 1) if len(order) else []


def _kept_together(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in a, place in b) of the words that stay, as ``_banded`` has them; all rows have as many words."""
    (many, n), m = a.shape, b.shape[1]
    place, cost = np.arange(m + 1, dtype=np.int32), np.empty((n + 1, many, m + 1), np.int32)
    cost[0] = place
    for i in range(n):
        best = cost[i] + 1
        np.minimum(best[:, 1:], cost[i, :, :-1] + (b != a[:, i : i + 1]), out=best[:, 1:])
        cost[i + 1] = np.minimum.accumulate(best - place, axis=1) + place
    rows, i, k, out = np.arange(many), np.full(many, n), np.full(many, m), []
    while len(rows):
        here, same = cost[i, rows, k], a[rows, i - 1] == b[rows, k - 1]
        both = here == cost[i - 1, rows, k - 1] + ~same
        first = ~both & (here == cost[i - 1, rows, k] + 1)
        i, k = i - (both | first), k - ~first
        stay = both & same
        out.append((rows[stay], i[stay], k[stay]))
        on = (i > 0) & (k > 0)
        rows, i, k = rows[on], i[on], k[on]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def all_kept(words: np.ndarray, at_a: np.ndarray, n: np.ndarray, at_b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in a, place in b) of the words that stay in many pairs of readings, by row and place (see ``kept_words``).

    ``words`` are numbers, a reading is where it begins there and how many it has. Short ones of as many words are aligned at once.
    """
    out = [(np.zeros(0, np.int64),) * 3]
    short = (n <= SHORT) & (m <= SHORT)
    for r in np.flatnonzero(~short).tolist():
        kept = np.array(kept_words(words[at_a[r] : at_a[r] + n[r]], words[at_b[r] : at_b[r] + m[r]]), np.int64).reshape(-1, 2)
        out.append((np.full(len(kept), r), kept[:, 0], kept[:, 1]))
    rows = np.flatnonzero(short)
    head, tail = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for g in _alike(n[rows], m[rows]):
        some = rows[g]
        least = np.arange(min(n[some[0]], m[some[0]]))
        if len(least):
            same = words[at_a[some][:, None] + least] == words[at_b[some][:, None] + least]
            head[some] = np.logical_and.accumulate(same, axis=1).sum(1)
            same = words[(at_a + n)[some][:, None] - 1 - least] == words[(at_b + m)[some][:, None] - 1 - least]
            tail[some] = np.minimum(np.logical_and.accumulate(same, axis=1).sum(1), len(least) - head[some])
    for count, from_a, from_b in ((head, np.zeros_like(n), np.zeros_like(m)), (tail, n - tail, m - tail)):
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out.append((np.repeat(np.arange(len(n)), count), np.repeat(from_a, count) + step, np.repeat(from_b, count) + step))
    a, b = n - head - tail, m - head - tail
    rows = rows[(a[rows] > 0) & (b[rows] > 0)]
    for g in _alike(a[rows], b[rows]):
        some = rows[g]
        x, y = int(a[some[0]]), int(b[some[0]])
        together = max(1, (CELLS >> 2) // ((x + 1) * (y + 1)))
        for part in np.split(some, range(together, len(some), together)):
            row, i, k = _kept_together(words[(at_a + head)[part][:, None] + np.arange(x)], words[(at_b + head)[part][:, None] + np.arange(y)])
            out.append((part[row], i + head[part][row], k + head[part][row]))
    row, i, k = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((i, row))
    return row[order], i[order], k[order]


@F.arrow_udf(T.ArrayType(_BLOCK))
def reading_blocks(mine: pa.Array, other: pa.Array) -> pa.Array:
    """The blocks in which two arrays of words differ (places from 0, ends exclusive); a null array has no words."""
    n, m = (np.asarray(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64) for v in (mine, other))
    flat = pa.chunked_array([v.flatten().cast(pa.string()) for v in (mine, other)]).combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    words = np.asarray(flat.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False), np.int64)
    row, i, k = all_kept(words, np.cumsum(n) - n, n, n.sum() + np.cumsum(m) - m, m)
    # what lies between words that stay, the ends of both readings behind the last
    row, i, k = np.concatenate([row, np.arange(len(n))]), np.concatenate([i, n]), np.concatenate([k, m])
    order = np.lexsort((k, i, row))
    row, i, k = row[order], i[order], k[order]
    new = np.diff(row, prepend=-1) != 0
    first, since = (np.where(new, 0, np.roll(x, 1) + 1) for x in (i, k))
    found = (i > first) | (k > since)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[found], minlength=len(n)))])
    parts = [pa.array(x[found].astype(np.int32)) for x in (first, i, since, k)]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(parts, _BLOCK.names))


def edits_of(found: Column) -> Column:
    """The word edits that blocks stand for."""
    return F.aggregate(found, F.lit(0).cast("long"), lambda n, b: n + F.greatest(b["last"] - b["first"], b["until"] - b["from"]))


def swaps(found: Column, heard: Column) -> Column:
    """(place, heard): what the other reading has for a word. Blocks of as many words pair one by one; a word read as several has them all."""
    size = lambda b: b["last"] - b["first"]
    entry = lambda place, text: F.struct(place.cast("int").alias("place"), text.alias("heard"))
    each = lambda b: F.transform(F.sequence(F.lit(0), size(b) - 1), lambda k: entry(b["first"] + k, F.element_at(heard, b["from"] + k + 1)))
    several = lambda b: F.array(entry(b["first"], F.array_join(F.slice(heard, b["from"] + 1, b["until"] - b["from"]), " ")))
    pairs = lambda b: F.when(size(b) == b["until"] - b["from"], each(b)).when(size(b) == 1, several(b))
    useful = F.filter(found, lambda b: (size(b) > 0) & (b["until"] > b["from"]) & ((size(b) == b["until"] - b["from"]) | (size(b) == 1)))
    return F.flatten(F.transform(useful, pairs))
