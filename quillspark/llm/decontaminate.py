"""Benchmark decontamination: rare n-gram seeds join texts to test items, Smith-Waterman alignment scores them.

The n-grams of an item are its pairs of words one or two places apart. One pass counts them in all texts. An
alignment that reaches the score sought must hold n-grams of a certain weight, so an item's commonest ones, as
long as they weigh three fourths of that together, leave a fourth to the rarer rest: the seeds. A second pass joins
texts to items by those seeds, and misses nothing where it looks only at windows of text that hold the fourth. There
it counts all n-grams of the item, by lookups under item and n-gram, and aligns the item with the words around where
there are enough; the score is the best local alignment as a share of the item's alignment with itself. The index of a block of items is bounded by
``block_grams``, what a task holds of its hits by ``HITS``, however many items share a pair of words: a larger benchmark is taken in several blocks, each with two passes of its own, so that nothing
unbounded is broadcast.

Defined results: null and empty texts and items match nothing; an item of which one word would reach the score
counts only where it stands whole; of places of equal score the first counts; repeated rows are reported once a
row; texts of any length are read whole; rows with null item_id take part, and ids may be of any type; columns beside
doc_id, item_id and the texts play no part, or are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.common import prepare, read, text_of
from quillspark.llm.textbytes import MULTIPLIER, mixed, slices, words

LEAKED = 0.5
BLOCK_GRAMS = 500_000
MATCH, MISMATCH, SPACE = 2, -1, 1
FILTER_BITS = 20
#: Grams of the items looked for at once, and hits of seeds held at once, or those of one window.
PART_GRAMS, HITS = 100_000, 500_000


@dataclass
class Items:
    """Word hashes of a block of items and their word pairs; ``gram``, ``item`` and ``step`` go together, by gram, and
    ``rare`` marks the seeds among them: all, until frequencies are known."""

    ids: list
    words: list[np.ndarray]
    gram: np.ndarray
    item: np.ndarray
    step: np.ndarray
    rare: np.ndarray

    def seeds(self, count: np.ndarray, least: float) -> Items:
        """With the commonest grams of each item, by ``count`` of each entry, unmarked while an alignment needs ``enough`` weight of others."""
        need = needed(np.array([len(w) for w in self.words], np.int64), least)[1]
        order = np.lexsort((self.gram, -count, self.item))
        weight = np.where(self.step[order] == 1, 2, 1)
        total = np.cumsum(weight)
        first = np.searchsorted(self.item[order], np.arange(len(self.words)))
        before = np.concatenate([[0], total])[first]
        rare = np.zeros(len(order), bool)
        rare[order] = total - before[self.item[order]] > (need - enough(need))[self.item[order]]
        return replace(self, rare=rare)


@dataclass
class Index:
    """Sorted grams, each perhaps several times, with a bitmap before them."""

    gram: np.ndarray
    screen: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.screen = np.zeros(1 << FILTER_BITS, bool)
        self.screen[(self.gram >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def ranges(self, h: np.ndarray, row: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the first word, first entry, number of entries) of the pairs of words of a row, ``d`` apart, that are grams here."""
        value = _pair(h[: max(len(h) - d, 0)], h[d:])
        at = np.flatnonzero(self.screen[(value >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = at[row[at] == row[at + d]]
        left = np.searchsorted(self.gram, value[at])
        n = np.searchsorted(self.gram, value[at], "right") - left
        return at[n > 0], left[n > 0], n[n > 0]


def _spread(at: np.ndarray, left: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``at`` ``n`` times, with ``left``, ``left`` + 1, ... beside it."""
    return np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - left, n)


def needed(length: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own least score, weight of grams, words of the text) that an alignment of an item of ``length`` words takes.

    Of L words, M in line and a cost of B, a score of ``least`` needs 2 M - B >= 2 L least. So among the M - 1 steps
    from one word in line to the next, those without cost, counted twice, and those of cost one add up to
    2 L least - 2 at least, within M + B <= 3 L - 2 L least words of the text. Both kinds are grams, and no gram of an
    item is used twice.
    """
    own = np.where(length * least > 1 + 1e-9, least, 1.0)  # where one word would do, only the whole item does
    return own, np.maximum(np.ceil(2 * length * own - 2 - 1e-9).astype(np.int64), 1), np.ceil(3 * length - 2 * length * own).astype(np.int64)


def enough(need: np.ndarray) -> np.ndarray:
    """Weight of seeds that a window must hold to be looked at: a fourth of what it needs."""
    return np.maximum(need // 4, 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a + np.uint64(1)) + mixed(b + np.uint64(2)))


def items_of(rows: list[tuple]) -> Items:
    """rows: (item_id, text). Pairs are of words one or two places apart; a lone word is a pair with itself, of step 0."""
    column = pa.array([t or "" for _, t in rows], pa.string())
    every: list[np.ndarray] = []
    for lo, hi, data, offsets in slices(column):
        h, _, _, row = words(data, offsets)
        first = np.searchsorted(row, np.arange(hi - lo + 1))
        every += [h[first[i] : first[i + 1]] for i in range(hi - lo)]
    gram, item, step = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, w in enumerate(every):
        for d in (0,) if len(w) == 1 else (1, 2):
            pairs = _pair(w[: max(len(w) - d, 0)], w[d:])
            gram.append(pairs)
            item.append(np.full(len(pairs), i))
            step.append(np.full(len(pairs), d))
    gram, item, step = (np.concatenate(x) for x in (gram, item, step))
    order = np.argsort(gram, kind="stable")
    return Items([i for i, _ in rows], every, gram[order], item[order], step[order], np.ones(len(order), bool))


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over words for each pair: (best score, end of it in the text). Pairs go in batches of like lengths."""
    best, end = np.zeros(len(items)), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: (len(texts[i]), len(items[i])))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * max(len(texts[order[hi]]), 1) <= 40_000 and len(texts[order[hi]]) <= 2 * len(texts[order[lo]]) + 64:
            hi += 1
        part = order[lo:hi]
        wide, tall = max(len(texts[i]) for i in part), max(len(items[i]) for i in part)
        a, b = np.zeros((len(part), tall), np.uint64), np.zeros((len(part), wide), np.uint64)
        in_a, in_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
        for r, i in enumerate(part):
            a[r, : len(items[i])], in_a[r, : len(items[i])] = items[i], True
            b[r, : len(texts[i])], in_b[r, : len(texts[i])] = texts[i], True
        row = np.zeros((len(part), wide + 1), np.int32)
        slope = np.arange(wide + 1, dtype=np.int32) * SPACE
        top, place = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
        for k in range(tall):
            same = (a[:, k : k + 1] == b) & in_a[:, k : k + 1] & in_b
            new = np.zeros_like(row)
            np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] - SPACE, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            # spaces within this row: a running maximum, less one for each step
            row = np.maximum.accumulate(new + slope, axis=1) - slope
            row[:, 1:][~in_b] = 0
            row[~in_a[:, k]] = 0
            j = row.argmax(1)
            value = row[np.arange(len(part)), j]
            place[value > top] = j[value > top]
            top = np.maximum(top, value)
        best[part], end[part] = top, place
        lo = hi
    return best, end


def _blocks(benchmark: DataFrame, block_grams: int, text: str) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_grams`` n-grams."""
    size = benchmark.select(F.sum(2 * F.size(F.split(text_of(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("n")).first().n or 0
    blocks = max(1, -(-size // block_grams))
    for b in range(blocks):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", text), F.lit(blocks)) == b)
        rows = sorted(((r[0], r[1]) for r in part.select("item_id", text).collect()), key=lambda r: (r[0] is None, str(r[0]), r[1] or ""))
        yield items_of(rows)


def _counted(docs: DataFrame, items: Items, least: float, text: str) -> Items:
    """``items`` with the seeds that follow from how often each gram stands in all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = Index(np.unique(items.gram)), np.zeros(len(np.unique(items.gram)), np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                h, _, _, row = words(data, offsets)
                for d in (0, 1, 2):
                    total += np.bincount(index.ranges(h, row, d)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(index.gram[some].view(np.int64)), pa.array(total[some])], ["gram", "n"])

    # As many rows as the block has grams.
    rows = docs.select(text_of(text)).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    gram = np.array([r.gram for r in rows], np.int64).view(np.uint64)
    order = np.argsort(gram)
    gram, n = gram[order], np.array([r.n for r in rows], np.int64)[order]
    at = np.minimum(np.searchsorted(gram, items.gram), max(len(gram) - 1, 0))
    known = gram[at] == items.gram if len(gram) else np.zeros(len(items.gram), bool)
    return items.seeds(np.where(known, n[at] if len(gram) else 0, 0), least)


@dataclass
class Part:
    """The seeds of some items of like lengths: ``item`` and ``weight`` of each entry of ``index``; no window is wider than ``pad``."""

    index: Index
    item: np.ndarray
    weight: np.ndarray
    pad: int


class Search:
    """A block of items, ready to be found in texts.

    Work grows with the places where seeds stand times the items that share them, and with the windows that hold
    enough of an item's seeds; memory with ``HITS``, ``PART_GRAMS`` and a slice of text, whatever the items share.
    """

    def __init__(self, items: Items, least: float) -> None:
        self.words = items.words
        self.length = np.array([len(x) for x in items.words], np.int64)
        self.own, self.need, self.span = needed(self.length, least)
        self.enough = enough(self.need)
        self.salt = mixed(np.arange(1, len(items.words) + 1, dtype=np.uint64) * MULTIPLIER)
        # Grams of an item, once each: where the step is one somewhere, neighbours in a text may weigh two.
        self.key, entry = np.unique(mixed(items.gram ^ self.salt[items.item]), return_inverse=True)
        self.weight = 1 + (np.bincount(entry, items.step == 1, len(self.key)) > 0).astype(np.int64)
        first = np.zeros(len(self.key), np.int64)
        first[entry] = np.arange(len(entry))
        seed = np.zeros(len(self.key), bool)
        seed[entry[items.rare]] = True
        gram, item, weight = items.gram[first[seed]], items.item[first[seed]], self.weight[seed]
        order = np.lexsort((item, gram))
        gram, item, weight = gram[order], item[order], weight[order]
        # Items in order of length, cut where their grams fill a part.
        by_length = np.argsort(self.length, kind="stable")
        part = np.zeros(len(self.words), np.int64)
        part[by_length] = (np.cumsum(2 * self.length[by_length]) - 1) // PART_GRAMS
        self.parts = []
        for k in np.unique(part[item]):
            own = part[item] == k
            self.parts.append(Part(Index(gram[own]), item[own], weight[own], int(self.span[part == k].max()) + 1))

    def windows(self, part: Part, h: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first word, end) of the stretches of text around enough seeds of an item, apart from each other."""
        looked = [part.index.ranges(h, row, d) for d in (0, 1, 2)]
        cost = np.zeros(len(h) + 1, np.int64)
        for at, _, n in looked:
            cost[1:] += np.bincount(at, n, len(h)).astype(np.int64)
        cost = np.cumsum(cost)
        out, lo = [], 0
        wide = len(h) + part.pad * (len(bounds) + 1)
        while lo < len(h):
            hi = min(max(int(np.searchsorted(cost, cost[lo] + HITS, "right")) - 1, lo + part.pad), len(h))
            ats, items, weights = [], [], []
            for d, (at, left, n) in enumerate(looked):
                a, b = np.searchsorted(at, [lo, hi + part.pad])
                place, entry = _spread(at[a:b], left[a:b], n[a:b])
                item = part.item[entry]
                ok = (self.length[item] == 1) == (d == 0)
                ats.append(place[ok])
                items.append(item[ok])
                weights.append(part.weight[entry[ok]] if d == 1 else np.ones(int(ok.sum()), np.int64))
            at, item, weight = (np.concatenate(x) for x in (ats, items, weights))
            key = item * wide + at + row[at] * part.pad  # one line for each item; rows lie further apart than any window
            order = np.argsort(key)
            key, at, item, total = key[order], at[order], item[order], np.concatenate([[0], np.cumsum(weight[order])])
            stop = np.searchsorted(key, key + self.span[item], "right")
            good = np.flatnonzero((total[stop] - total[:-1] >= self.enough[item]) & (at < hi))
            at, item = at[good], item[good]
            out.append(self._merged(item, np.maximum(at - self.span[item], bounds[row[at]]), np.minimum(at + self.span[item] + 3, bounds[row[at] + 1]), row))
            lo = hi
        return self._merged(*(np.concatenate(x) for x in zip(*out, strict=True)), row)

    def _merged(self, item: np.ndarray, first: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of one item and row as one where less than two windows lie between them; ``end`` grows with ``first``."""
        order = np.lexsort((first, item))
        item, first, end = item[order], first[order], end[order]
        fresh = np.ones(len(item), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (row[first[1:]] != row[first[:-1]]) | (first[1:] - end[:-1] > 2 * self.span[item[1:]])
        start = np.flatnonzero(fresh)
        return item[start], first[start], np.maximum.reduceat(end, start) if len(start) else end

    def hits(self, h: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, place, weight) of the pairs of words in the stretches that are grams of their item, by stretch and place."""
        out = []
        for d in (0, 1, 2):
            n = np.where((self.length[item] == 1) == (d == 0), np.maximum(end - first - d, 0), 0)
            at, stretch = _spread(first, np.zeros_like(first), n)[1], np.repeat(np.arange(len(item)), n)
            at += np.repeat(first, n)
            value = mixed(_pair(h[at], h[at + d]) ^ self.salt[item[stretch]])
            entry = np.minimum(np.searchsorted(self.key, value), len(self.key) - 1)
            hit = self.key[entry] == value
            out.append((stretch[hit], at[hit], self.weight[entry[hit]] if d == 1 else np.ones(int(hit.sum()), np.int64)))
        stretch, at, weight = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((at, stretch))
        return stretch[order], at[order], weight[order]

    def aligned(self, h: np.ndarray, row: np.ndarray, bounds: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, score, grams, last word) of each place in the stretches whose alignment reaches its score."""
        stretch, at, weight = self.hits(h, item, first, end)
        item = item[stretch]
        total, key = np.concatenate([[0], np.cumsum(weight)]), stretch * (len(h) + int(self.span.max()) + 1) + at
        stop = np.searchsorted(key, key + self.span[item], "right")
        good = np.flatnonzero(total[stop] - total[:-1] >= self.need[item])
        # A place ends where the next is too far away for one alignment to reach both.
        fresh = np.ones(len(good), bool)
        fresh[1:] = (np.diff(stretch[good]) > 0) | (np.diff(at[good]) > 2 * self.span[item[good[1:]]])
        start = np.flatnonzero(fresh)
        head, tail = good[start], good[np.concatenate([start[1:], [len(good)]])[: len(start)] - 1]
        i, r = item[head], row[at[head]]
        begin = np.maximum(at[head] - self.span[i], bounds[r])
        last = np.minimum(at[tail] + self.span[i] + 1, bounds[r + 1])
        top, place = align([self.words[k] for k in i], [h[a:b] for a, b in zip(begin, last, strict=True)])
        score = top / (MATCH * self.length[i])
        keep = score >= self.own[i]
        return tuple(x[keep] for x in (r, i, score, stop[tail] - head, begin + place - bounds[r]))

    def found(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score, grams, last word) of each pair of a text and an item that reaches its score, the best place only."""
        out = [tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.float64, np.int64, np.int64))]
        for lo, hi, data, offsets in slices(column):
            h, _, _, row = words(data, offsets)
            bounds = np.searchsorted(row, np.arange(hi - lo + 1))
            for part in self.parts if len(h) else ():
                item, first, end = self.windows(part, h, row, bounds)
                cuts = np.flatnonzero(np.diff(np.cumsum(end - first) // HITS, prepend=-1)).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(item)], strict=False):
                    r, *rest = self.aligned(h, row, bounds, item[a:b], first[a:b], end[a:b])
                    out.append((r + lo, *rest))
        r, item, score, seeds, end = (np.concatenate(c) for c in zip(*out, strict=True))
        if not len(r):
            return r, item, score, seeds, end
        order = np.lexsort((end, -score, item, r))
        r, item, score, seeds, end = (c[order] for c in (r, item, score, seeds, end))
        best = np.concatenate([[True], (r[1:] != r[:-1]) | (item[1:] != item[:-1])])
        seeds = np.add.reduceat(seeds, np.flatnonzero(best))
        return r[best], item[best], score[best], seeds, end[best]


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", least: float = LEAKED, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, last_word) of every document and item whose alignment reaches ``least``: n_seeds
    is how many pairs of words there are n-grams of the item, last_word the word after the alignment."""
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    out = None
    prepare(docs.sparkSession)
    for items in _blocks(benchmark, block_grams, item_text):
        items = _counted(docs, items, least, text)
        ids = pa.array(items.ids, to_arrow_type(benchmark.schema["item_id"].dataType))

        def find(batches: Iterator[pa.RecordBatch], items: Items = items, ids: pa.Array = ids) -> Iterator[pa.RecordBatch]:
            search = Search(items, least)
            for batch in batches:
                r, item, score, seeds, end = search.found(batch.column(1))
                keep = score >= least
                columns = [batch.column(0).take(pa.array(r[keep])), ids.take(pa.array(item[keep])), *(pa.array(x[keep]) for x in (score, seeds, end))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "n_seeds", "last_word"])

        found = docs.select("doc_id", text_of(text)).mapInArrow(find, f"doc_id {kind}, item_id {item_kind}, score double, n_seeds long, last_word long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", least: float = LEAKED, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """The documents that hold no item; they aren't shuffled."""
    place, every = docs.columns.index(text), docs
    prepare(docs.sparkSession)
    for items in _blocks(benchmark, block_grams, item_text):
        items = _counted(every, items, least, text)

        def keep(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            search = Search(items, least)
            for batch in batches:
                r, _, score, _, _ = search.found(batch.column(place))
                clean = np.ones(batch.num_rows, bool)
                clean[r[score >= least]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and test item that leaked into it: the alignment's score, its seeds, and where it ends."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
