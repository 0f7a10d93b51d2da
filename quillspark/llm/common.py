"""Shared plumbing of the training-data operators: reading, shared folders, native span search."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where no checkpoint folder is set and the session runs on this machine alone, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/quillspark"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started, and keep their batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # its default: whole texts are long rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name inside the folder that all executors share.

    That folder is the one of ``spark.checkpoint.dir``, or else of ``SparkContext.setCheckpointDir``. Without
    either, sessions on one machine use a local one and others raise. What is written there may be read until
    the driver ends, and goes then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_CHECKPOINTS
    path = f"{base.rstrip('/')}/quillspark-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a folder; a session that has ended, or a folder that nothing was written to, is no error."""
    with contextlib.suppress(Exception):
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names like ``names`` that ``df`` has none of, whatever their case."""
    taken, tail = {c.lower() for c in df.columns}, ""
    while any(f"__{n}{tail}".lower() in taken for n in names):
        tail += "_"
    return tuple(f"__{n}{tail}" for n in names)


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and fixes rows once and for all."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sql_text(value: str) -> str:
    """A SQL string literal that keeps backslashes."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, pattern: str) -> str:
    """SQL: every leftmost non-overlapping match as ``struct<s, e, hit>``; code points, end exclusive.

    ``text`` and ``pattern`` are SQL expressions. The text between matches comes from split(), the
    matches from regexp_extract_all(), and a running sum of both lengths gives the places.
    """
    pieces = (
        f"filter(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), "
        "(p, h) -> named_struct('gap', char_length(p), 'hit', h)), x -> x.hit is not null)"
    )
    return (
        f"aggregate({pieces}, named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,hit:string>>)), "
        "(acc, x) -> named_struct('at', acc.at + x.gap + char_length(x.hit), 'out', concat(acc.out, "
        "array(named_struct('s', acc.at + x.gap, 'e', acc.at + x.gap + char_length(x.hit), 'hit', x.hit)))), "
        "acc -> acc.out)"
    )
