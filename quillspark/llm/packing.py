"""Best-fit packing of tokenised documents into sequences, with certified bounds and exchange.

Texts are tokenised once; longer documents are cut so that all pieces but the first are whole
sequences. The rest is dealt by hash into partitions of bounded size, each packed best-fit
decreasing. Dual feasible functions give a lower bound on each partition's sequences; a partition that
meets its bound is certified and stays as it is. Partitions with a gap exchange: the documents of their
sequences that aren't full go into pools that draw on all such partitions, are packed best-fit
decreasing anew and certified in turn, and a pool keeps the result if it takes fewer sequences. Rounds end
when every partition is certified, when the bound over all lengths is met, when none gained, or at ``rounds``.

A certified partition may leave its last sequence short: at most one sequence in ``partition_pieces`` pieces
over what one packing of everything could reach.

Defined results: null and empty texts are documents of the closing id alone; repeated rows are packed
each; an empty table gives no rows; texts of any length are cut, never shortened; columns beside doc_id
and the text, whatever their names, play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import prepare, read, text_of, written
from quillspark.llm.tokens import token_ids

CAPACITY = 1024
CLOSE = 2
#: Pieces of a partition on average, and partitions' worth of pieces in a pool.
PARTITION_PIECES, POOL_PARTITIONS = 1 << 15, 4

PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than ``capacity`` if there are several."""
    head = n % capacity if n > capacity else n
    starts = ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]
    return starts


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of ``lengths`` takes fewer sequences."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of several dual feasible functions over how many pieces there are of each length."""
    count, size = count.astype(np.int64), np.arange(capacity + 1)
    if not count.any():
        return 0
    best = -(-int(count @ size) // capacity)
    # Those over capacity - k count as whole, those under k not at all, for every k to one half.
    above, below = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    for k in range(1, capacity // 2 + 1):
        whole, middle = int(above[capacity - k + 1]), int(below[capacity - k] - below[k - 1])
        best = max(best, whole + -(-middle // capacity))
    # x(k + 1) rounded down, over k, unless it is whole already.
    for k in range(1, 33):
        scaled = size * (k + 1)
        exact = scaled % capacity == 0
        value = np.where(exact, size * k, scaled // capacity * capacity)  # in units of 1 / (k capacity)
        best = max(best, -(-int(count @ value) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins, best-fit decreasing."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    mask, n = 0, 0  # bit r: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - left
        left -= size
        if left:
            room[left].append(b)
            mask |= 1 << left
    return bins, offsets, n


def tokenised_pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, close: int = CLOSE, path: str | None = None) -> DataFrame:
    """The written table of pieces (see PIECE); ``uid`` is theirs alone."""
    prepare(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(value.as_py(), path), close).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((uid, doc_id, k, start, length, zlib.crc32(ids[start : start + length])))
                    uid += 1
            names = [x.split()[0] for x in PIECE.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    return written(docs.select(F.col("doc_id").cast("long"), text_of(text)).mapInArrow(make, PIECE))


PACKED = f"{PIECE}, part long, bin long, offset long, full boolean, gap long"


def _packer(mark: int, capacity: int):
    """Pack a group anew; ``mark`` makes part numbers of this round."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)  # equal results whatever order they come in
        lengths = rows["length"].to_numpy()
        bins, offsets, n = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        before = rows.groupby(["part", "bin"]).ngroups if (rows["part"] >= 0).all() else n + 1
        if n < before:
            rows["part"], rows["bin"], rows["offset"] = (mark << 36) + key[0], bins, offsets
            rows["full"] = np.bincount(bins, lengths, n)[bins] == capacity
        rows["gap"] = min(n, before) - bound
        return rows.drop(columns="pool")

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = 4) -> tuple[DataFrame, list[dict]]:
    """All pieces with ``sequence_id`` and ``offset``; and the certificates: for each round its partitions, those
    certified, the pieces that went in, all sequences so far, and the bound over all lengths."""
    # Whole pieces have negative sequence ids, so that they never meet those of partitions.
    whole = pieces.filter(F.col("length") == capacity).select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    # As many rows as there are lengths.
    count = np.zeros(capacity + 1, np.int64)
    for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect():
        count[r.length] = r.n
    moved, bound = int(count.sum()), bound_of_counts(count, capacity)
    pools = max(1, -(-moved // partition_pieces))
    fresh = rest.select("*", *[F.lit(-1).cast("long").alias(c) for c in ("part", "bin", "offset")], F.lit(False).alias("full"), F.lit(0).cast("long").alias("gap"))
    turn = fresh.withColumn("pool", F.pmod(F.xxhash64("uid"), F.lit(pools)))
    done: list[DataFrame] = []
    report: list[dict] = []
    settled = 0
    for k in range(rounds + 1):
        packed = written(turn.groupBy("pool").applyInPandas(_packer(k, capacity), PACKED))
        bins = packed.groupBy("part", "bin").agg(F.count("*").alias("n"), (F.first("full") | (F.max("gap") == 0)).alias("stays"), F.max("gap").alias("gap"))
        stats = bins.agg(
            F.count("*").alias("all"),
            F.count_if("stays").alias("stay"),
            F.sum(F.when(~F.col("stays"), F.col("n"))).alias("open"),
            F.count_distinct("part").alias("parts"),
            F.count_distinct(F.when(F.col("gap") == 0, F.col("part"))).alias("certified"),
        ).first()
        report.append({"round": k, "partitions": stats.parts, "certified": stats.certified, "pieces": moved, "sequences": settled + stats.all, "bound": bound})
        if k == rounds or not stats.open or settled + stats.all <= bound or (k and report[-1]["sequences"] >= report[-2]["sequences"]):
            done.append(packed)
            break
        # Certified partitions stay, and so do full sequences. The documents of the others go, sequence by sequence,
        # into pools that draw on all partitions with a gap and stay of a bounded size.
        done.append(packed.filter("full or gap = 0"))
        settled += stats.stay
        moved = stats.open
        pools = max(1, -(-moved // (POOL_PARTITIONS * partition_pieces)))
        turn = packed.filter("not full and gap > 0").withColumn("pool", F.pmod(F.xxhash64("part", "bin", F.lit(k)), F.lit(pools)))
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    number = F.shiftleft(F.col("part"), 20) + F.col("bin")
    names = [x.split()[0] for x in PIECE.split(", ")]
    packed = packed.select(*names, number.alias("sequence_id"), "offset")
    return packed.unionByName(whole), report


def pack_documents(docs: DataFrame, text: str = "text", report: list[dict] | None = None) -> DataFrame:
    """The places of all pieces of ``docs``; the certificates of each round are added to ``report``."""
    packed, rounds = pack(tokenised_pieces(docs, text))
    if report is not None:
        report += rounds
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: its document, its place there, its digest, and its place in a sequence."""
    return pack_documents(read(spark, sf_dir, "documents"))
