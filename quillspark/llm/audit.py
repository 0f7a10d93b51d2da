"""What each order of filters removes: all orders at once, from one table of first failures.

A document's failures of five filters are five bits. For every set of failures and every order of the filters a
table says at which step the document goes (0: never): 32 rows of 120 columns. Tasks look their rows up in it, count
(part, order, step, label) with ``bincount`` and return one row for each part and order, which Spark adds up. All else
follows from those counts: what fails a filter is what an order that begins with it removes first, and what fails no other
is what an order that ends with it removes last.

Texts are read once, into a narrow written table. A text's first document is a grouped minimum, and a document is matched with it by
its own id, so that a group of copies of any size is never one group of rows.

Defined results: a null text is empty (it fails A, and no others but E: none of its words are repeated); a null ``lang`` is the part of the empty string;
a row with a null id is never a copy and makes no other a copy; rows of equal id and text are not copies of each other, each counts; several
labels of an id count as 1 where any is 1, null labels as 0; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import prepare, read, text_of, written

FILTERS = "ABCDE"
ORDERS = list(itertools.permutations(range(len(FILTERS))))
#: Fixed limits of the filters A to D.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SIGNS = 200, 50, 3, b"#$%&*|"
#: Parts that a task counts at a time.
PARTS = 256
_UPPER, _CONTINUED = bytes(range(65, 91)), bytes(range(128, 192))
_STEPS, _LABELS = len(FILTERS) + 1, 4


def first_failures() -> np.ndarray:
    """The step (from 1) at which documents with a set of failures go in each order, 0 where they stay; a row for each set."""
    table = np.zeros((1 << len(FILTERS), len(ORDERS)), dtype=np.int64)
    for failures in range(1, len(table)):
        table[failures] = [1 + next(i for i, f in enumerate(order) if failures >> f & 1) for order in ORDERS]
    return table


def failures_of(text: bytes) -> int:
    """Filters A to D as bits. ``bytes.split`` cuts at just the six characters of ASCII white space."""
    words = text.split()
    size = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _CONTINUED)))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, _UPPER))) > MAX_UPPER_PERCENT * size) << 2
        | (len(text.translate(None, SIGNS)) < len(text)) << 3
    )


def _checked(docs: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """Written table of (id, part, failures of A to D, digest of the text)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.as_py() for v in batch.column(2)]
            bits, keys = [failures_of(t) for t in texts], [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(keys, pa.binary())], names=["id", "part", "failures", "digest"])

    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("part", T.StringType()), T.StructField("failures", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text_of(f"`{text}`").cast("binary").alias("text"))
    return written(rows.mapInArrow(check, schema))


def failures(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, failures) of every document, with E: the same text has a smaller id."""
    rows = _checked(docs, id, text, part)
    firsts = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    return rows.join(firsts, ["id", "digest"], "left").select("id", "part", F.col("failures").bitwiseOR(copy).alias("failures"))


def counts(rows: DataFrame) -> DataFrame:
    """(part, nth order, n_0 ... n_23) from rows of (part, failures, label): documents by step and label."""
    cells = len(ORDERS) * _STEPS * _LABELS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, places = first_failures(), np.arange(len(ORDERS)) * _STEPS
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            grid = np.concatenate([v.reshape(len(ORDERS), -1) for v in held.values()])
            names = [p for p in held for _ in ORDERS]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.tile(np.arange(len(ORDERS), dtype=np.int32), len(held))), *[pa.array(grid[:, i]) for i in range(grid.shape[1])]], names=["part", "nth", *[f"n_{i}" for i in range(grid.shape[1])]])

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            failed, label = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo in range(0, len(which), 4096):  # rows x orders are held at a time
                hi = lo + 4096
                cell = (places + table[failed[lo:hi]]) * _LABELS + label[lo:hi, None]
                for p in np.unique(which[lo:hi]):
                    n = np.bincount(cell[which[lo:hi] == p].ravel(), minlength=cells)
                    held[names[p]] = held.get(names[p], 0) + n
                    if len(held) >= PARTS:
                        yield out()
                        held.clear()
        if held:
            yield out()

    columns = [f"n_{i}" for i in range(_STEPS * _LABELS)]
    partial = rows.select("part", "failures", "label").mapInArrow(count, f"part string, nth int, {', '.join(f'{c} bigint' for c in columns)}")
    return partial.groupBy("part", "nth").agg(*[F.sum(c).alias(c) for c in columns])


def filter_audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: what is kept and removed there, and what that costs."""
    prepare(docs.sparkSession)
    told = labels.where(f"`{id}` IS NOT NULL").groupBy(F.col(f"`{id}`").alias("id")).agg(F.max(F.expr("int(coalesce(quality = 1, false))")).alias("good"), F.max(F.expr("int(coalesce(toxic = 1, false))")).alias("toxic"))
    rows = failures(docs, id, text, part).join(told, "id", "left").select("part", "failures", F.expr("2 * coalesce(good, 0) + coalesce(toxic, 0)").alias("label"))
    at = lambda step, among: " + ".join(f"n_{step * _LABELS + i}" for i in among)
    names = F.array(*[F.lit("".join(FILTERS[f] for f in o)) for o in ORDERS])
    steps = ", ".join(f"struct({s} AS step, {at(s, range(_LABELS))} AS removed, {at(s, (2, 3))} AS good_lost, {at(s, (1, 3))} AS toxic_lost, {' + '.join(at(t, range(_LABELS)) for t in (0, *range(s + 1, _STEPS)))} AS kept)" for s in range(1, _STEPS))
    told_by_step = counts(rows).select("part", names[F.col("nth")].alias("filter_order"), F.expr(f"inline(array({steps}))"))
    same = Window.partitionBy("part", F.expr("substr(filter_order, step, 1)"))
    at_step = lambda n: F.max(F.when(F.col("step") == n, F.col("removed")).otherwise(0)).over(same)
    return told_by_step.select(
        "part", "filter_order", "step", "kept", "removed", (at_step(1) - F.col("removed")).alias("redundant"), at_step(len(FILTERS)).alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(same).alias("shapley")
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of five filters over all documents, by language."""
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
b AS MATERIALIZED (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
  [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
   regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS f FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS MATERIALIZED (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY part, f),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS p FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT g.part, o.p, i.x AS step, g.n, g.good, g.toxic, g.f[o.p[i.x]] AS fails, len(list_filter(o.p[1:i.x - 1], lambda q: g.f[q])) > 0 AS gone, len(list_filter(g.f, lambda q: q)) = 1 AS single FROM g, o, i),
t AS (SELECT part, p, step, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails AND single THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY part, p, step)
SELECT part, array_to_string(list_transform(p, lambda q: chr(64 + q)), '') AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, p[step]) AS BIGINT) AS shapley FROM t"""
