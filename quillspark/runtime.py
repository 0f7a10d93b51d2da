"""What a session needs before Python functions of this library run on its executors."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """Let Python workers import the library wherever the driver was started."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the one that the driver and all executors share; a local one only where Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/quillspark"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
