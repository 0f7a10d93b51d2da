"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics come from the bytes of a batch at once (numpy over Arrow buffers). Trees are fitted on the
driver from a bounded sample of labelled rows (``max_rows``, the smallest hashes of doc_id), on
quantile bins with second-order gains, and flattened into arrays of perfect trees, over which numpy
walks all rows of a batch level by level. Labels, language, source and doc_id are never statistics.

Defined results: null and empty texts have statistics of zero and a score like any other; texts of any length
are counted whole; equal texts have equal scores; rows of one doc_id are scored each, and one of them, the least by
hash and text, stands for it in the fit; without usable labels every score is 0.5; with labels of one class every score
is their smoothed share; columns of any name are carried along, but one with the score's name gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import prepare, read, text_of
from quillspark.llm.textbytes import slices, words

#: Byte classes whose shares are statistics.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t",
    "newline": b"\n\r",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "mark": b"#$%&*@^~",
    "bar": b"|_=<>\\/+",
    "quote": b"\"'()[]{}-`",
    "other": bytes(range(128, 256)),
}
STATISTICS = [*CLASSES, "log_bytes", "log_words", "word_length", "long_words", "short_words", "one_letter", "lines", "line_length", "line_spread", "repeated_lines", "distinct_words", "words_a_stop", "top_word", "upper_words"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A float32 row of STATISTICS for every text of a slice."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    out = np.zeros((n, len(STATISTICS)), np.float32)
    some = np.maximum(size, 1)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.full(256, len(CLASSES), np.uint8)
    for k, members in enumerate(CLASSES.values()):
        kinds[list(members)] = k
    # one count for each pair of text and class
    counts = np.bincount(row_of * (len(CLASSES) + 1) + kinds[data], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)
    out[:, : len(CLASSES)] = counts[:, : len(CLASSES)] / some[:, None]
    h, start, end, row = words(data, offsets)
    n_words = np.bincount(row, minlength=n)
    each = np.maximum(n_words, 1)
    length = end - start
    share = lambda what: np.bincount(row, what, n) / each
    k = len(CLASSES)
    out[:, k], out[:, k + 1] = np.log1p(size), np.log1p(n_words)
    out[:, k + 2], out[:, k + 3], out[:, k + 4], out[:, k + 5] = share(length), share(length > 12), share(length < 4), share(length == 1)
    # lines: hashes from the words in them, so that blank lines count as one kind
    breaks = np.flatnonzero(data == 10)
    n_lines = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=n)[:n] + (size > 0)
    out[:, k + 6] = np.log1p(n_lines)
    out[:, k + 7] = np.log1p(size / np.maximum(n_lines, 1))
    line = np.searchsorted(breaks, start, "right") + row  # rows part lines as well
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])]))
        of, total = row[first], np.add.reduceat(h, first)
        lengths = np.diff(np.concatenate([first, [len(h)]])).astype(np.float64)
        some_lines = np.bincount(of, minlength=n)
        filled = np.maximum(some_lines, 1)
        mean = np.bincount(of, lengths, n) / filled
        out[:, k + 8] = np.sqrt(np.maximum(np.bincount(of, lengths**2, n) / filled - mean**2, 0)) / np.maximum(mean, 1)
        out[:, k + 9] = (some_lines - _distinct(of, total, n)[0]) / filled
        kinds_of, top = _distinct(row, h, n)
        out[:, k + 10], out[:, k + 12] = kinds_of / each, top / each
    out[:, k + 11] = np.log1p(n_words / (1.0 + counts[:, 5]))
    out[:, k + 13] = share((data[start] >= 65) & (data[start] <= 90)) if len(h) else 0
    return out


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often the commonest comes."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]))
    run = np.diff(np.concatenate([first, [len(r)]]))
    top = np.zeros(n)
    np.maximum.at(top, r[first], run)
    return np.bincount(r[first], minlength=n), top


@dataclass(frozen=True)
class Trees:
    """Perfect trees of one depth: ``feature`` and ``split`` by (tree, node), ``leaf`` by (tree, leaf); go right if value > split."""

    base: float
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        nodes = self.feature.shape[1]
        for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while nodes and at.size and at[0] < nodes:
                at = 2 * at + 1 + (x[rows, feature[at]] > split[at])
            raw += leaf[at - nodes]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Boost the logistic loss on quantile bins; every level of a tree comes from one histogram for each feature."""
    nodes, leaves = (1 << depth) - 1, 1 << depth
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, nodes), np.int64), np.zeros((0, nodes), np.float32), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    n_features, raw = len(edges), np.full(len(y), base)
    features, splits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, split = np.zeros(nodes, np.int64), np.full(nodes, np.inf, np.float32)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            place = at - first
            best = np.full(width, 1e-6)
            cut_bin = np.full(width, bins)
            for f in range(n_features):
                if not len(edges[f]):
                    continue
                cell = place * bins + binned[f]
                sums = [np.bincount(cell, w, width * bins).reshape(width, bins) for w in (g, h, None)]
                left = [np.cumsum(s, 1) for s in sums]
                total = [s[:, -1:] for s in left]
                gain = left[0] ** 2 / (left[1] + ridge) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
                gain[(left[2] < least) | (total[2] - left[2] < least)] = -1
                gain = gain[:, : len(edges[f])]
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best[better] = gain[np.arange(width), k][better]
                feature[first : first + width][better] = f
                split[first : first + width][better] = edges[f][k][better]
                cut_bin[better] = k[better]
            f = feature[at]
            at = 2 * at + 1 + (binned[f, np.arange(len(y))] > cut_bin[place])
        end = at - nodes
        value = -rate * np.bincount(end, g, leaves) / (np.bincount(end, h, leaves) + ridge)
        raw += value[end]
        features.append(feature)
        splits.append(split)
        values.append(value)
    return Trees(base, np.array(features), np.array(splits), np.array(values))


def _statistics_of(docs: DataFrame, carry: str, text: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float32()))], ["carry", "x"])

    kind = dict(docs.dtypes)[carry]
    return docs.select(carry, text_of(text)).mapInArrow(make, f"carry {kind}, x array<float>")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, text: str = "text", **options) -> Trees:
    """Fit on at most ``max_rows`` labelled rows that aren't held out."""
    prepare(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("double").alias("y"))
    # The sample is bounded by max_rows, and so is its broadcast.
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    # One text for each sampled label, whatever the documents of its id: what is collected is bounded as well.
    own = sample.groupBy("doc_id").agg(F.min("y").alias("y"))
    body = docs.select("doc_id", text_of(text).alias(text))
    chosen = body.join(F.broadcast(own), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64(text), text)).alias("t"))
    rows = _statistics_of(chosen.select("y", F.col(f"t.{text}").alias(text)), "y", text).collect()
    # Equal models whatever order the rows come in.
    table = np.array(sorted([r.carry, *r.x] for r in rows), np.float64).reshape(-1, 1 + len(STATISTICS))
    return fit(table[:, 1:].astype(np.float32), table[:, 0], **options)


def score_quality(docs: DataFrame, model: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """Every row of ``docs`` with its score, in a column ``name``."""
    prepare(docs.sparkSession)
    if text != name:
        docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])
    text_at = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(statistics(data, offsets)) for _, _, data, offsets in slices(batch.column(text_at))]
            scores = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in [*((c, k) for c, k in docs.dtypes), (name, "double")])
    return docs.mapInArrow(score, schema)


def accepted(docs: DataFrame, model: Trees, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.scores(statistics(data, offsets)) >= least))

    return docs.mapInArrow(keep, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it's held out, its score, and the class at 0.5."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    scored = _scored_ids(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scored_ids(docs: DataFrame, model: Trees) -> DataFrame:
    """As score_quality, without sending the texts back."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.scores(statistics(data, offsets)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", text_of("text")).mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
