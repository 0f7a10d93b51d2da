"""Token counts from flat token files without an index: a vectorised separator scan.

Documents are written as one stream of ids per shard, each closed by an end-of-document id, cut into
blocks of a fixed size wherever that falls. The scan finds the end ids in each block with numpy and
knows nothing of documents; a prefix scan over block summaries (ends so far, place of the last end)
stitches documents across block borders. Shards are bounded by the input splits that made them.

Defined results: a null or empty text is a document of no tokens; an empty table gives no rows; ids
after the last end of a shard form one document that is not closed; repeated rows count each.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import prepare, read, text_of, written

END = 50256
BLOCK_TOKENS = 1 << 16
RANKS = "byte_bpe_50k.tiktoken"
#: Runs of white space from this length on are cut out before the splitting pattern, which goes back over them, sees them.
LONG_SPACE = 20_000
#: What the splitting pattern takes for white space, and the special token of these vocabularies.
SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPECIAL = "<|endoftext|>"
_LONG = re.compile(f"(?<!{SPACE}){SPACE}{{{LONG_SPACE},}}")


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """The byte-level BPE of 50,257 ids. Its ranks file holds the vocabulary of byte_bpe_50k.json, and gives
    the same ids several times faster; ``<|endoftext|>`` in a text is id 50256 in both."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: END})


def token_ids(text: str, path: str | None = None, special: bool = True) -> np.ndarray:
    """Ids of a text. Without ``special``, special tokens' strings are ordinary text, and no id is 50256.

    A long run of white space is a piece of its own, as the splitting pattern has it: all of it at the end of
    a text or before a special token, else all but its last character, which goes with what follows.
    """
    own = encoder(path)
    ids = (lambda t: own.encode_to_numpy(t, allowed_special="all")) if special else (lambda t: own.encode_to_numpy(t, disallowed_special=()))
    if len(text) < LONG_SPACE:
        return ids(text)
    parts, at = [], 0
    for m in _LONG.finditer(text):
        stop = m.end() if m.end() == len(text) or (special and text.startswith(SPECIAL, m.end())) else m.end() - 1
        parts += [ids(text[at : m.start()]), np.array(own._encode_single_piece(text[m.start() : stop]), np.uint32)]
        at = stop
    return np.concatenate([*parts, ids(text[at:])]) if parts else ids(text)


def write_flat(docs: DataFrame, text: str = "text", block_tokens: int = BLOCK_TOKENS, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write shards of little-endian unsigned 32-bit ids; returns (blocks, members).

    blocks: shard long, block int, payload binary; members: shard, ordinal long, doc_id. Both come from one
    written table, so that a lost task can't deal documents out anew.
    """
    prepare(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, ordinal = TaskContext.get().partitionId(), 0, 0
        parts: list[np.ndarray] = []
        have = 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, have, block
            flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
            stop = len(flat) if last else len(flat) // block_tokens * block_tokens
            for at in range(0, stop, block_tokens):
                yield row([shard], [block], [flat[at : at + block_tokens].astype("<u4").tobytes()], [None], [None])
                block += 1
            parts, have = [flat[stop:]], len(flat) - stop

        for batch in batches:
            n = batch.num_rows
            yield row([shard] * n, [None] * n, [None] * n, range(ordinal, ordinal + n), batch.column(0))
            ordinal += n
            for value in batch.column(1):
                ids = token_ids(value.as_py(), path, special=False)
                parts += [ids, np.array([END], "<u4")]
                have += len(ids) + 1
                if have >= 4 * block_tokens:
                    yield from cut(False)
        yield from cut(True)

    def row(shard, block, payload, ordinal, doc_id) -> pa.RecordBatch:
        columns = [pa.array(list(shard), pa.int64()), pa.array(list(block), pa.int32()), pa.array(list(payload), pa.binary()), pa.array(list(ordinal), pa.int64())]
        ids = doc_id if isinstance(doc_id, pa.Array) else pa.array(doc_id, pa.int64())
        return pa.RecordBatch.from_arrays([*columns, ids.cast(pa.int64())], ["shard", "block", "payload", "ordinal", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of(text)).mapInArrow(write, "shard long, block int, payload binary, ordinal long, doc_id long")
    table = written(rows)
    blocks = table.filter("payload is not null").select("shard", "block", "payload")
    members = table.filter("ordinal is not null").select("shard", "ordinal", "doc_id")
    return blocks, members


def read_flat(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 4) -> DataFrame:
    """Flat token files (any number of shards of at most 2 GB, ids of ``width`` bytes) as blocks.

    A file is cut once, so that no block's row holds the whole of it.
    """
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path).withColumn("shard", F.xxhash64("path"))
    last = f"cast(greatest((length - 1) div {size}, 0) as int)"
    cut = f"transform(sequence(0, {last}), i -> named_struct('block', i, 'payload', substring(content, i * {size} + 1, {size})))"
    return files.select("shard", F.explode(F.expr(cut)).alias("b")).select("shard", "b.block", "b.payload")


def scan_blocks(blocks: DataFrame, end: int = END, block_tokens: int = BLOCK_TOKENS, width: int = 4) -> DataFrame:
    """One row per document of each shard: shard, ordinal, start and n_tokens (in ids), closed boolean."""
    prepare(blocks.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, sizes = [], []
            for value in batch.column(2):
                ids = np.frombuffer(value.as_buffer(), f"<u{width}")
                ends.append(np.flatnonzero(ids == end).astype(np.int64))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["shard", "block", "ends", "size"])

    # Written: the scan of ids happens once, though closed and open documents both start from it.
    found = written(blocks.select("shard", F.col("block").cast("int"), "payload").mapInArrow(scan, "shard long, block int, ends array<long>, size long"))
    # The prefix scan goes over one row per block, not over ids.
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("block").cast("long") * block_tokens
    stitched = found.select("*", place.alias("place")).select(
        "shard",
        "place",
        "ends",
        "size",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("seen"),
        F.coalesce(F.max(F.col("place") + F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1)).alias("last"),
        F.lead("block").over(Window.partitionBy("shard").orderBy("block")).isNull().alias("final"),
    )
    closed = stitched.select("shard", "place", "seen", "last", "ends", F.posexplode("ends").alias("i", "e")).select(
        "shard",
        (F.col("seen") + F.col("i")).alias("ordinal"),
        F.expr("case when i = 0 then last else place + ends[i - 1] end + 1").alias("start"),
        (F.col("place") + F.col("e")).alias("stop"),
        F.lit(True).alias("closed"),
    )
    open_ = (
        stitched.filter("final")
        .select(
            "shard",
            (F.col("seen") + F.size("ends")).alias("ordinal"),
            F.expr("case when size(ends) > 0 then place + element_at(ends, -1) else last end + 1").alias("start"),
            (F.col("place") + F.col("size")).alias("stop"),
            F.lit(False).alias("closed"),
        )
        .filter("stop > start")
    )
    return closed.unionByName(open_).select("shard", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: where it starts in its shard of the flat token files, and how many ids it has."""
    blocks, members = write_flat(read(spark, sf_dir, "documents"))
    return members.join(scan_blocks(blocks), ["shard", "ordinal"]).select("doc_id", "shard", "start", "n_tokens", "closed")
