"""A registry of named queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``f(spark, sf_dir)`` as ``name``."""

    def put(f: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"two queries are named {name}")
        REGISTRY[name] = Entry(f, sql)
        return f

    return put
