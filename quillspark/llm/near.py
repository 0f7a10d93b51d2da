"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of five words. Sets are embedded by minhash; a node of a tree picks
one coordinate (or two, one time in four: 1.25 on average, the inverse of the similarity sought) by a
hash of its path, and a set goes to the child that its own token there names: only sets that share
the sampled token stay together. Nodes of at most ``limit`` sets are compared by brute force on their
sketches; larger ones are split again; what still shares a long path is taken as one dense bucket.

Runs repeat this from other roots until the recall that is sought. It is measured: of a bounded sample of
texts, those that share one more coordinate (which no path picks) are compared by brute force, and the share
of pairs of 0.8 or more of their coordinates that the runs have joined must reach ``target``, else further
runs follow. What theory says of the first RUNS: a pair of similarity 0.8 is lost by a run with 0.16, 0.27, 0.36
or 0.42 where its nodes are small at the first to the fourth level, and so by twelve with 3e-10, 2e-7, 4e-6
or 3e-5, less where other copies join the two; the brute force on sketches loses 2e-8.

The buckets give candidate components; within them every pair of distinct texts that their sizes allow is
verified with the exact Jaccard similarity of whole sets, in blocks of bounded size, and only
counts and one edge for each text leave a block. So a large group of near copies costs a number of
block pairs, not of rows. Large components fall into classes of size, and only those next to each other
meet. Equal texts are one class from the start.

Defined results: texts without words, null ones included, are linked to nothing and form a class with
equal texts only; texts of fewer than five words have one run of all their words; texts of any length are
sets of all their runs; repeated rows are copies; rows with null doc_id take part, and a class without any
doc_id has a null class_id; columns of any name.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import prepare, read, text_of, unused, written
from quillspark.llm.graph import components
from quillspark.llm.textbytes import MULTIPLIER, mixed, shingles, slices, words

COORDINATES, RUNS, LEVELS, LIMIT = 64, 12, 4, 64
SIMILAR, CANDIDATE, WORDS = 0.8, 0.5, 5
#: Recall that is sought on a sample of so many texts; runs that follow while it is missed, and all runs at most.
TARGET, SAMPLE, MORE, MOST = 0.9999, 2048, 6, 60
#: Members that a dense bucket links to one of them at most, as an average.
FAN = 256
#: Texts of a block of exact comparisons, and of one in components of more than so many.
BLOCK, WIDE_BLOCK, WIDE = 128, 1024, 1 << 14
#: Bytes of a batch to Python, where Spark's own limit is 64 MB (a longer text is a batch of its own), and tokens sorted at once.
BATCH_BYTES, TOKENS = 4 << 20, 1 << 19
_A = mixed(np.arange(1, 2 * COORDINATES + 3, dtype=np.uint64) * MULTIPLIER)


def _prepare(spark: SparkSession) -> None:
    """Besides what all operators set: batches bounded by bytes. Long texts and their tokens make batches of 2,000 rows
    too large to hold in the JVM, on their way and in the worker, by each task at once."""
    prepare(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864", "67108864b", "64MB"):  # its default
        spark.conf.set(key, str(BATCH_BYTES))


def runs_of(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, row = words(data, offsets)
    return shingles(h, row, len(offsets) - 1, n)[:2]


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """Written table of (k, doc_id, n, sig): the text's digest, how many different runs it has, and its minhash
    with one coordinate more than paths pick from (null without words)."""
    _prepare(docs.sparkSession)
    first, second = _A[: COORDINATES + 1], _A[COORDINATES + 1 :] | np.uint64(1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2)):
                n = hi - lo
                value, row = runs_of(data, offsets)
                count = np.bincount(row, minlength=n)
                some = np.flatnonzero(count)
                sig = np.zeros((n, COORDINATES + 1), "<u4")
                if len(some):
                    at = np.concatenate([[0], np.cumsum(count[some])[:-1]])
                    for t in range(COORDINATES + 1):
                        sig[some, t] = np.minimum.reduceat((((value ^ first[t]) * second[t]) >> np.uint64(32)).astype(np.uint32), at)
                key = value ^ mixed(row.astype(np.uint64))
                order = np.argsort(key)
                new = np.ones(len(key), bool)
                new[1:] = key[order][1:] != key[order][:-1]
                different = np.bincount(row[order][new], minlength=n)
                rows = [sig[i].tobytes() if count[i] else None for i in range(n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, n) for c in (0, 1)), pa.array(different, pa.int64()), pa.array(rows, pa.binary())], ["k", "doc_id", "n", "sig"])

    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select(F.unhex(F.md5(text_of(text))).alias("k"), "doc_id", text_of(text).alias("t"))
    return written(keyed.mapInArrow(make, f"k binary, doc_id {kind}, n long, sig binary"))


def _children(path: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, child nodes) for each pick of the nodes that the sets are in."""
    every = np.arange(len(path))
    for pick in range(2):
        rows = every if not pick else every[mixed(path + np.uint64(17)) % np.uint64(4) == 0]
        own = mixed(path[rows] + np.uint64(101 + pick))
        at = (own % np.uint64(COORDINATES)).astype(np.int64)
        yield rows, mixed(own ^ mixed(sig[rows, at].astype(np.uint64) * MULTIPLIER + np.uint64(1)))


def _split(sets: DataFrame, runs: range | None = None) -> DataFrame:
    """(k, node) one level down. sets: (k, sig), and without ``runs`` node; else their roots are made."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(len(k), -1)
            roots = [np.full(len(k), mixed(np.array([r + 1], np.uint64) * MULTIPLIER)[0]) for r in runs or ()] or [batch.column(2).to_numpy().astype(np.int64).view(np.uint64)]
            for path in roots:
                for rows, node in _children(path, sig):
                    yield pa.RecordBatch.from_arrays([k.take(pa.array(rows)), pa.array(node.view(np.int64))], ["k", "node"])

    return sets.mapInArrow(make, "k binary, node long")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal first ``keys`` columns of sorted batches, whole over batch borders."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        columns = [batch.column(c) for c in range(keys)]
        for c in columns:
            change |= np.array([a != b for a, b in zip(c[:-1].to_pylist(), c[1:].to_pylist(), strict=True)], bool) if pa.types.is_binary(c.type) else np.diff(c.to_numpy()) != 0
        cuts = np.flatnonzero(change) + 1
        lo = 0
        for cut in [*cuts.tolist(), batch.num_rows]:
            part = batch.slice(lo, cut - lo)
            if not lo and rest and any(rest[0].column(c)[0] != part.column(c)[0] for c in range(keys)):
                yield pa.Table.from_batches(rest)
                rest = []
            if cut < batch.num_rows:
                yield pa.Table.from_batches([*rest, part])
                rest = []
            else:
                rest = [*rest, part]
            lo = cut
    if rest:
        yield pa.Table.from_batches(rest)


def _least_linked(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix, the least row that can be reached."""
    label = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_edges(rows: DataFrame) -> DataFrame:
    """Edges from sets to the least candidate that their bucket links them to. rows: (node, k, sig)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in groups(batches, 1):
            k = group.column(1).to_pylist()
            sig = np.frombuffer(b"".join(group.column(2).to_pylist()), "<u4").reshape(len(k), -1)
            sig = sig[:, :COORDINATES]
            near = (sig[:, None, :] == sig[None, :, :]).mean(2) >= CANDIDATE
            for i, j in enumerate(_least_linked(near).tolist()):
                if i != j:
                    a.append(k[i])
                    b.append(k[j])
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.select("node", "k", "sig").repartition("node").sortWithinPartitions("node", "k").mapInArrow(make, "a binary, b binary")


def _tree(rows: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """Edges (a, b) that join all k of each node, of at most ``most`` sets, as a tree of about ``fan`` children a set."""
    parts, depth = [], max(1, math.ceil(math.log(most, fan)))
    for d in reversed(range(depth)):
        rows = rows.select("node", "k", F.pmod(F.xxhash64("k"), F.lit(fan**d)).alias("part"))
        least = rows.groupBy("node", "part").agg(F.min("k").alias("b"))
        parts.append(rows.join(least, ["node", "part"]).select(F.col("k").alias("a"), "b"))
        rows = least.select("node", F.col("b").alias("k"))
    return functools.reduce(DataFrame.unionByName, parts)


def candidate_edges(sets: DataFrame, runs: range = range(RUNS), levels: int = LEVELS, limit: int = LIMIT) -> DataFrame:
    """Edges whose components hold every pair found by ``runs``. sets: written table of (k, sig), one row per distinct text."""
    _prepare(sets.sparkSession)
    # Nodes of all levels are met at once: they are hashes of whole paths, so no two levels share one.
    lives, smalls, trees = [], [], []
    live = written(_split(sets.select("k", "sig"), runs))
    for level in range(1, levels + 1):
        sizes = written(live.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"))
        small, large = sizes.filter(F.col("n") <= limit), sizes.filter(F.col("n") > limit)
        lives.append(live)
        smalls.append(small.select("node"))
        most = large.agg(F.max("n")).first()[0]
        if not most:
            break
        if level == levels:
            trees.append(_tree(live.join(large.select("node"), "node"), most))
        else:
            live = written(_split(live.join(large.select("node"), "node").join(sets, "k").select("k", "sig", "node")))
    union = functools.partial(functools.reduce, DataFrame.unionByName)
    buckets = _bucket_edges(union(lives).join(union(smalls), "node").join(sets, "k"))
    return union([buckets, *trees]).filter("a != b").distinct()


def sampled_pairs(sets: DataFrame, sample: int = SAMPLE, similar: float = SIMILAR) -> list[tuple[bytes, bytes]]:
    """Pairs of like sketches, by brute force among at most ``sample`` texts: those that come first by the coordinate
    that no path picks, so that like texts are in the sample together."""
    own = F.substring("sig", 4 * COORDINATES + 1, 4)
    rows = [(bytes(r.k), bytes(r.sig)) for r in sets.orderBy(own, "k").limit(sample).select("k", "sig").collect()]
    sig = np.frombuffer(b"".join(x for _, x in rows), "<u4").reshape(-1, COORDINATES + 1)
    cuts = [0, *(np.flatnonzero(np.diff(sig[:, -1].astype(np.int64))) + 1).tolist(), len(rows)]
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        for i in range(lo, hi - 1):
            like = np.flatnonzero((sig[i + 1 : hi, :COORDINATES] == sig[i, :COORDINATES]).mean(1) >= similar)
            out += [(rows[i][0], rows[i + 1 + j][0]) for j in like.tolist()]
    return out


def recall_of(candidates: DataFrame, pairs: list[tuple[bytes, bytes]]) -> float:
    """The share of ``pairs`` that are in one component of ``candidates`` (k, label); 1 if there are none."""
    if not pairs:
        return 1.0
    # As many rows as the sample has texts at most.
    ks = candidates.sparkSession.createDataFrame([(k,) for k in {k for p in pairs for k in p}], "k binary")
    label = {bytes(r.k): bytes(r.label) for r in candidates.join(F.broadcast(ks), "k").collect()}
    return sum(a in label and label[a] == label.get(b) for a, b in pairs) / len(pairs)


def candidate_components(sets: DataFrame, runs: int = RUNS, more: int = MORE, most: int = MOST, target: float = TARGET, sample: int = SAMPLE, **options) -> tuple[DataFrame, int, float]:
    """(k, label) of the texts that runs join, how many runs it took, and their measured recall."""
    pairs = sampled_pairs(sets, sample)
    edges = candidate_edges(sets, range(runs), **options)
    while True:
        edges = written(edges)
        candidates = components(edges, stored=True).withColumnRenamed("node", "k")
        recall = recall_of(candidates, pairs)
        if recall >= target or runs >= most:
            return candidates, runs, recall
        edges = edges.unionByName(candidate_edges(sets, range(runs, runs + more), **options))
        runs += more


def _linked(tokens: list[np.ndarray], similar: float, most: int = TOKENS) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least ``similar``. tokens: hashes in order; ranges of
    about ``most`` of them are counted one after the other."""
    size = np.array([len(t) for t in tokens], np.float64)
    common = np.zeros((len(tokens), len(tokens)), np.float64)
    ranges = max(1, math.ceil(size.sum() / most))
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    ends = [[0, *np.searchsorted(t, bounds).tolist(), len(t)] for t in tokens]
    for r in range(ranges):
        _count_common([t[e[r] : e[r + 1]] for t, e in zip(tokens, ends, strict=True)], common)
    near = common >= similar * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(near, False)
    return near


def _count_common(tokens: list[np.ndarray], common: np.ndarray) -> None:
    """Add to ``common`` how many tokens each two sets share."""
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    value, column, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096  # columns of a dense part
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(tokens), width), np.float32)
        part[row[i:j], column[i:j] - lo] = 1
        common += part @ part.T


def verified(texts: DataFrame, similar: float = SIMILAR, block: int = BLOCK, wide_block: int = WIDE_BLOCK) -> DataFrame:
    """(k, links, root) of exact comparisons. texts: (k, label, size, sizes, t), each k once or in equal rows; ``size`` is
    a text's class of size in its component, ``sizes`` a map from those classes to their texts.

    A class of more than ``block`` texts is dealt into blocks by hash, and each pair of blocks of one class or of two
    next to each other is a group of its own; within one, rows are sets, not pairs.
    """
    _prepare(texts.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(4)):
                value, row = runs_of(data, offsets)
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                rows = [np.unique(value[ends[i] : ends[i + 1]]).astype("<u8").tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(4)), pa.array(rows, pa.binary())], ["k", "label", "size", "sizes", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, links, roots = [], [], []
        for group in groups(batches, 5):
            k, left = group.column(5).to_pylist(), group.column(7).to_numpy()
            first = [i for i in range(len(k)) if not i or k[i] != k[i - 1]]  # equal rows come together
            k, left = [k[i] for i in first], left[first]
            near = _linked([np.frombuffer(group.column(6)[i].as_buffer(), "<u8") for i in first], similar)
            if group.column(1)[0] != group.column(3)[0] or group.column(2)[0] != group.column(4)[0]:
                near &= left[:, None] != left[None, :]  # pairs within a block are another group's
            count = near.sum(1)
            for i, j in enumerate(_least_linked(near).tolist()):
                if count[i]:
                    ks.append(k[i])
                    links.append(int(count[i]))
                    roots.append(k[j])
            if len(ks) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], ["k", "links", "root"])
                ks, links, roots = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], ["k", "links", "root"])

    made = texts.select("k", "label", "size", "sizes", "t").mapInArrow(sets, "k binary, label binary, size int, sizes map<int,long>, tokens binary")
    blocks = lambda at: f"cast(ceil(coalesce(try_element_at(sizes, {at}), 0) / case when try_element_at(sizes, {at}) > {WIDE} then {wide_block} else {block} end) as int)"
    every = lambda at, body: f"case when {blocks(at)} > 0 then transform(sequence(0, {blocks(at)} - 1), o -> {body}) else array() end"
    met = lambda c, i, d, j, left: f"named_struct('c', {c}, 'i', {i}, 'd', {d}, 'j', {j}, 'left', {left})"
    own = made.withColumn("own", F.expr(f"cast(pmod(xxhash64(k), {blocks('size')}) as int)"))
    groups_of = [
        every("size", met("size", "least(own, o)", "size", "greatest(own, o)", "own <= o")),
        every("size + 1", met("size", "own", "size + 1", "o", "true")),
        every("size - 1", met("size - 1", "o", "size", "own", "false")),
    ]
    dealt = own.withColumn("g", F.explode(F.expr(f"concat({', '.join(groups_of)})"))).select("label", "g.c", "g.i", "g.d", "g.j", "k", "tokens", "g.left")
    keys = ["label", "c", "i", "d", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "k").mapInArrow(compare, "k binary, links long, root binary")


def sized(candidates: DataFrame, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """``candidates`` (k, label, n, ...) with ``size`` and ``sizes`` (see ``verified``). Sets of that similarity lie in one
    class of size or in two next to each other; a component of at most ``block`` texts is one class."""
    width = math.log(1 / similar) * (1 + 1e-6)
    total = candidates.groupBy("label").agg(F.count("*").alias("members"))
    classed = candidates.join(total, "label").withColumn("size", F.when(F.col("members") > block, F.floor(F.log("n") / width)).otherwise(0).cast("int"))
    classed = written(classed.drop("members"))
    # As many entries as there are powers of 1.25 up to the longest text.
    sizes = classed.groupBy("label", "size").agg(F.count("*").alias("m")).groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("size", "m"))).alias("sizes"))
    return classed.join(sizes, "label")


def _texts_of(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(k, label, size, sizes, t) of the documents that ``wanted`` (k, least, label, size, sizes) names.

    Members of components are a share of all texts at every size, so both sides are shuffled. They are a small share
    of it, without text: a partition's share of them is hashed, and texts pass it unsorted.
    """
    wanted = wanted.select(F.col("k").alias("wk"), "label", "size", "sizes", F.col("least").alias("wl")).hint("shuffle_hash")
    keyed = docs.select(F.unhex(F.md5(text_of(text))).alias("k"), F.col("doc_id").alias("least"), text_of(text).alias("t"))
    texts = keyed.join(wanted, F.col("k").eqNullSafe(F.col("wk")) & F.col("least").eqNullSafe(F.col("wl")))
    return texts.select("k", "label", "size", "sizes", "t")


def near_classes(docs: DataFrame, text: str = "text", similar: float = SIMILAR, **options) -> tuple[DataFrame, DataFrame]:
    """(table, classes): the sketches' (k, doc_id), and for each distinct text k, least (doc_id), n_copies,
    n_links, class_id and stays (whether its least document is the one of its class that stays)."""
    table = sketches(docs, text)
    classes = written(table.groupBy("k").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    candidates, _, _ = candidate_components(classes.filter("sig is not null").select("k", "sig"), **options)
    wanted = sized(candidates.join(classes.select("k", "least", "n"), "k"), similar)
    found = written(verified(_texts_of(docs, wanted, text), similar))
    links = found.groupBy("k").agg(F.sum("links").alias("n_links"))
    linked = components(found.select(F.col("k").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "k")
    # Nulls come last: a class has a null class_id only if no document of it has an id.
    order = F.struct(F.col("least").isNull().alias("none"), "least", "k")
    # Written, a row for each class and one for each member: a class of very many texts meets its row in a join that
    # Spark splits, and no later step reads it by the task that made it.
    first = written(linked.join(classes.select("k", "least"), "k").groupBy("label").agg(F.min(order).alias("first")))
    of = written(linked.join(first, "label").select("k", F.col("first.least").alias("class_id"), (F.col("k") == F.col("first.k")).alias("stays")))
    classes = classes.select("k", "least", "n_copies").join(links, "k", "left").join(of, "k", "left")
    alone = F.col("stays").isNull()
    classes = classes.select(
        "k",
        "least",
        "n_copies",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("least")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("stays", F.lit(True)).alias("stays"),
    )
    return table.select("k", "doc_id"), written(classes)


def near_duplicates(docs: DataFrame, text: str = "text", similar: float = SIMILAR, **options) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id that links reach), n_links (other texts at
    ``similar`` or more), n_copies (documents of the same text, itself included)."""
    table, classes = near_classes(docs, text, similar, **options)
    return table.join(classes.select("k", "class_id", "n_links", "n_copies"), "k").select("doc_id", "class_id", "n_links", "n_copies")


def representatives(docs: DataFrame, text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The document of the least doc_id of each class, with all its columns."""
    _, classes = near_classes(docs, text, similar)
    own, k, least = unused(docs, "own", "k", "least")
    keep = classes.filter("stays").select(F.col("k").alias(k), F.col("least").alias(least))
    keyed = docs.withColumn(own, F.unhex(F.md5(text_of(text))))
    kept = keyed.join(keep, F.col(own).eqNullSafe(F.col(k)) & F.col("doc_id").eqNullSafe(F.col(least)))
    return kept.dropDuplicates([k, least]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its class of near copies, its links to other texts, and its copies."""
    return near_duplicates(read(spark, sf_dir, "documents"))
