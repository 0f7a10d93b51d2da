"""How far two orders agree: pairs in the same and in opposite order, counted in n log n and in blocks of bounded size.

Points are sorted by the first measure and dealt into blocks. A pair in opposite order lies in one block, or in one block of the
second measure, or in different blocks of both. The first two are counted inside blocks; the last needs only how many points each pair of
blocks shares, which is the same question over far fewer points with weights. So no group of rows, however large, comes together in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.runtime import prepare, shared_folder

#: Points in a block, as an average; a task holds some hundred bytes for each.
BLOCK = 1 << 18


def inversions(group: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each group (numbers from 0, ascending), the weight of its pairs of which the earlier has the greater ``y``.

    Ranks are split bit by bit from the highest: a pair in opposite order parts where the earlier one has a bit that the later one lacks.
    """
    out = np.zeros(int(group[-1]) + 1 if len(group) else 0, np.int64)
    if len(y) < 2:
        return out
    order = np.lexsort((y, group))
    new = np.ones(len(y), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (y[order][1:] != y[order][:-1])
    rank = np.empty(len(y), np.int64)
    rank[order] = np.cumsum(new) - 1
    at = np.arange(len(y))
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        r, weight = rank[at], w[at]
        one = (r >> bit & 1).astype(bool)
        ahead = np.cumsum(np.where(one, weight, 0))
        node = r >> bit + 1
        begins = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        before = np.where(begins > 0, ahead[begins - 1], 0)
        ahead -= np.repeat(before, np.diff(np.r_[begins, len(r)]))
        np.add.at(out, group[at[~one]], (weight * ahead)[~one])
        at = at[np.argsort(r >> bit, kind="stable")]
    return out


def _counted(kept: str, last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Inversions of each group of a block; and of groups that may go on in others, weights by the column ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        name = rows["g"].combine_chunks()
        group = np.zeros(len(rows), np.int64)
        group[1:] = np.cumsum(pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False))
        w = rows["w"].to_numpy()
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        here = TaskContext.get().partitionId()
        kind = rows.schema.field(kept).type
        names = ["g", "block", "v", "w", "inversions"]
        found = pa.array(inversions(group, rows["y"].to_numpy(), w))
        none = lambda t: pa.nulls(len(begins), t)
        yield pa.RecordBatch.from_arrays([name.take(pa.array(begins)), pa.array([here] * len(begins), pa.int32()), none(kind), none(pa.int64()), found], names=names)
        if last:
            edge = np.flatnonzero((group == 0) | (group == group[-1]))
            value = rows[kept].to_numpy()
            edge = edge[np.lexsort((value[edge], group[edge]))]
            g, v = group[edge], value[edge]
            first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
            weights = np.add.reduceat(w[edge], first)
            empty = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays([name.take(pa.array(edge[first])), pa.array([here] * len(first), pa.int32()), pa.array(v[first], kind), pa.array(weights), empty], names=names)

    return run


def _dealt(points: DataFrame, deal: tuple[str, ...], order: tuple[str, ...], kept: str, block: int) -> tuple[DataFrame, int]:
    """(g, block, v, w, inversions) of points in blocks that are ranges of ``deal``, read in ``order``; written, with the number of blocks."""
    blocks = max(1, -(-points.count() // block))
    kind = points.schema[kept].dataType.simpleString()
    rows = points.repartitionByRange(blocks, *deal).sortWithinPartitions(*order).select(*dict.fromkeys(("g", kept, "y", "w")))
    path = shared_folder(points.sparkSession, "agreement")
    schema = f"g string, block int, v {kind}, w long, inversions long"
    rows.mapInArrow(_counted(kept, blocks - 1), schema).write.parquet(path)
    return points.sparkSession.read.schema(schema).parquet(path), blocks


def discordances(points: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """Tables of (g, inversions) that add up to the weight of pairs with x < x' and y > y' of points (g, x, y, w).

    Equal x are read by y, and equal y by their block of x, so that ties are never in opposite order whatever block they fall into.
    """
    size = points.count()
    own, blocks = _dealt(points, ("g", "x", "y"), ("g", "x", "y"), "y", block)
    out = [own.where("inversions > 0").select("g", "inversions")]
    if blocks > 1:
        rest = own.where("v IS NOT NULL").select("g", F.col("block").alias("x"), F.col("v").alias("y"), "w")
        across, blocks = _dealt(rest, ("g", "y", "x"), ("g", "x", "y"), "x", block)
        out.append(across.where("inversions > 0").select("g", "inversions"))
        if blocks > 1:
            cells = across.where("v IS NOT NULL").select("g", F.col("v").alias("x"), F.col("block").alias("y"), "w")
            out += discordances(cells, block if cells.count() < size else 2 * block)
    return out


def rank_agreement(rows: DataFrame, by: list[str], first: str, second: str, block: int = BLOCK) -> DataFrame:
    """For each group ``by``: n, pairs, concordant, discordant, tau (over all pairs), agreement (over pairs without ties) and order_accuracy.

    ``first`` may be of any type that has an order, ``second`` is a number, date or timestamp (decimals as doubles). Rows with a null in either, or
    no number in ``second``, take no part; a null in ``by`` is a group of its own; repeated rows count each; a pair with a tie in either is neither
    concordant nor discordant. A group of one row has no pairs, no tau, no order_accuracy, and agrees; an empty table gives no rows. Other
    columns take no part. Counts are exact below 3e9 rows a group.
    """
    prepare(rows.sparkSession)
    keys = [f"b{i}" for i in range(len(by))]
    kind = rows.schema[second].dataType
    number = F.col(f"`{second}`")
    if isinstance(kind, T.DateType):
        number = F.unix_date(number)
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(number)
    elif isinstance(kind, T.TimestampNTZType):
        number = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), number)
    number = number.cast("long" if isinstance(kind, (T.IntegralType, T.DatetimeType)) else "double")
    named = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col(f"`{first}`").alias("x"), number.alias("y"))
    named = named.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)").withColumn("g", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit(""))
    path = shared_folder(rows.sparkSession, "points")
    named.groupBy("g", *keys, "x", "y").agg(F.count("*").alias("w")).write.parquet(path)
    points = rows.sparkSession.read.parquet(path)

    pairs = lambda n: F.expr(f"{n} * ({n} - 1) DIV 2")
    tied = lambda c: points.groupBy("g", c).agg(F.sum("w").alias("n")).groupBy("g").agg(F.sum(pairs("n")).alias(f"tied_{c}"))
    whole = points.groupBy("g", *keys).agg(F.sum("w").alias("n"), F.sum(pairs("w")).alias("tied_both"))
    against = reduce(DataFrame.unionByName, discordances(points.select("g", "x", "y", "w"), block)).groupBy("g").agg(F.sum("inversions").alias("against"))
    found = whole.join(tied("x"), "g").join(tied("y"), "g").join(against, "g", "left").withColumn("discordant", F.coalesce("against", F.lit(0).cast("long")))
    found = found.withColumn("pairs", pairs("n")).withColumn("concordant", F.expr("pairs - tied_x - tied_y + tied_both - discordant"))
    return found.select(
        *[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", "pairs", "concordant", "discordant",
        F.expr("try_divide(concordant - discordant, pairs)").alias("tau"),
        F.expr("CASE WHEN n < 2 THEN CAST(1 AS DOUBLE) ELSE (concordant - discordant) / greatest(1, concordant + discordant) END").alias("agreement"),
        F.expr("1 - try_divide(discordant, pairs)").alias("order_accuracy"),
    )
