"""Line dedup over levelled sorted runs of line digests.

Documents come in batches from the largest ids down. A batch becomes a run: for each line key its number of documents
and the largest of their ids, bucketed and sorted by digest, so that runs meet each other bucket by bucket
without a shuffle. What earlier runs have settled (a key in ``enough`` documents keeps its lines in the document seen first, the one of the
largest id, whatever follows) is merge-anti-joined away before the batch adds its run; other keys add their counts. As soon as a
level holds ``fanout`` runs, they are compacted to one run of the next level. In the end one compaction of all runs gives the keys to drop.

Texts are read twice: once for the digests (16 bytes a line), once to drop lines. The digests meet the settled keys in one join whose hot
keys adaptive execution can split, since both sides are plain shuffles; each document then gets the digests of the lines
that it loses, and no more.

Defined results: a null or empty text is one empty line. Rows of equal id are one document, each row keeps or loses its own lines; rows
with a null id count for nothing and keep all lines. Keys shorter than ``least`` code points stay everywhere. An empty table gives no rows. Other columns
are not looked at. Ids are numbers or dates. Two lines are the same where 128 bits of their digests are.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import prepare, read, shared_dir, text_of, written

LEAST, ENOUGH, BATCHES, FANOUT = 40, 5, 8, 4
_CONTINUED = bytes(range(128, 192))
_PAIR = "array<struct<a: bigint, b: bigint>>"


def key_of(line: bytes) -> bytes:
    """The line without the six characters of ASCII white space at its ends, A-Z in lower case: just what these methods of bytes do."""
    return line.strip().lower()


def long_enough(key: bytes, least: int = LEAST) -> bool:
    return len(key) >= least and (key.isascii() or len(key.translate(None, _CONTINUED)) >= least)


def digests(docs: DataFrame, id: str, text: str, least: int = LEAST) -> DataFrame:
    """(id, a, b): the digests of the long lines of every row with an id, each once a row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, value in enumerate(batch.column(1)):
                mine = {xxhash.xxh3_128_digest(k) for line in value.as_py().split(b"\n") if len(line) >= least and long_enough(k := key_of(line), least)}
                rows += [i] * len(mine)
                keys += mine
            halves = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["id", "a", "b"])

    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    named = docs.where(f"`{id}` IS NOT NULL").select(F.col(f"`{id}`").alias("id"), text_of(f"`{text}`").cast("binary").alias("text"))
    return named.mapInArrow(make, schema)


class LineRuns:
    """An index of line keys that grows by batches of documents, those of larger ids first."""

    def __init__(self, spark: SparkSession, enough: int = ENOUGH, fanout: int = FANOUT) -> None:
        self.spark, self.enough, self.fanout = spark, enough, fanout
        #: As many buckets as a shuffle has partitions: the setting that is fitted to the input anyway.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.folder = shared_dir(spark)

    def add(self, lines: DataFrame) -> None:
        """A batch of (id, a, b); every id is smaller than those of earlier batches."""
        run = lines.dropDuplicates(["id", "a", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("last"))
        for name in self._names():
            run = run.join(self.spark.table(name).where(F.col("docs") >= self.enough).select("a", "b"), ["a", "b"], "left_anti")
        self._put(0, self._write(run))

    def settled(self) -> DataFrame:
        """Keys of enough documents, and the largest id that holds each."""
        names = self._names()
        return self._merged(names).where(F.col("docs") >= self.enough).select("a", "b", "last")

    def close(self) -> None:
        for name in self._names():
            self._forget(name)
        self.levels = []

    def _names(self) -> list[str]:
        return [n for level in reversed(self.levels) for n in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """One row a key. Files are read without their buckets here: Spark takes a union of bucketed scans for co-located, but puts their partitions one after the other."""
        rows = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*[f"{self.folder}/{n}" for n in names])
        return rows.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def _write(self, rows: DataFrame) -> str:
        """A new run; what is dealt by key already is not dealt again."""
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "a", "b")
        dealt.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", f"{self.folder}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _put(self, level: int, name: str) -> None:
        """Add a run to a level, and compact the level once it is full."""
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            full = self.levels[level]
            one = self._write(self._merged(full))
            self.levels[level] = []
            for old in full:
                self._forget(old)
            self._put(level + 1, one)

    def _forget(self, name: str) -> None:
        """Take a run out of the catalog; its files go with the folder when the driver ends."""
        with contextlib.suppress(Exception):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def settled_keys(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, enough: int = ENOUGH, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """Written tables: the digests of all long lines, and (a, b, last) of the keys that lose lines."""
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(f"`{id}`", shares, 10_000).alias("cuts")).first().cuts or []
    batch = sum((F.when(F.col("id") <= F.lit(c), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    lines = written(digests(docs, id, text, least).withColumn("batch", batch), ["batch"])
    runs = LineRuns(spark, enough)
    for i in range(len(set(cuts)) + 1):  # batch 0 has the largest ids
        runs.add(lines.where(F.col("batch") == i).select("id", "a", "b"))
    keys = written(runs.settled())
    runs.close()
    return lines, keys


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", **parameters: int) -> DataFrame:
    """Every row of ``docs`` as (id, kept text as bytes, n_lines, n_dropped)."""
    prepare(docs.sparkSession)
    least = parameters.get("least", LEAST)
    lines, keys = settled_keys(docs, id, text, **parameters)
    lost = lines.join(keys, ["a", "b"]).where(F.col("id") < F.col("last")).groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("lost"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, before, after = [], [], []
            for value, gone in zip(batch.column(1), batch.column(2), strict=True):
                mine = value.as_py().split(b"\n")
                rest = mine
                if gone.is_valid:
                    halves = gone.values.flatten()
                    pairs = np.stack([x.to_numpy() for x in halves], axis=1)
                    drops = {p.tobytes() for p in pairs}
                    rest = [line for line in mine if not (len(line) >= least and long_enough(k := key_of(line), least) and xxhash.xxh3_128_digest(k) in drops)]
                kept.append(b"\n".join(rest))
                before.append(len(mine))
                after.append(len(rest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(before, pa.int64()), pa.array([b - a for a, b in zip(after, before, strict=True)], pa.int64())], names=["id", "kept", "n_lines", "n_dropped"])

    schema = T.StructType([T.StructField(id, docs.schema[id].dataType), T.StructField("kept", T.BinaryType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    texts = docs.select(F.col(f"`{id}`").alias("id"), text_of(f"`{text}`").cast("binary").alias("text"))
    return texts.join(lost, "id", "left").select("id", "text", "lost").mapInArrow(drop, schema)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that at least five of them hold, kept in the one of the largest doc_id only."""
    return deduplicated(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
p AS (SELECT doc_id, r, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM t),
k AS MATERIALIZED (SELECT doc_id, r, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM p),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.r, k.i, k.line, coalesce(k.doc_id < f.last, false) AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, r"""
