"""Approximate nearest neighbours over balanced posting lists.

Equal vectors are one entry with its smallest ids (as many as an answer can hold), found with salted
limits, so that a very common vector costs no more than others. Centroids are means of a balanced
bisection of a bounded sample (``max_sample`` entries, the smallest hashes); there are at most
``max_lists``, a fourth of it, beyond which lists grow and are read in more blocks. An entry goes to its nearest centroid and, near a border, to further ones whose
distance is within a ratio. Centroids are searched by best-first walks over a neighbour graph in
memory, for entries and for queries. A query reads the lists within a distance ratio of its nearest
one; the ratio is set so that the sample's own neighbours, which lie further off than those among all
rows, are reached with a recall of RECALL. Lists and the queries that read them are
dealt into blocks of bounded size, and each pair of blocks is one matrix product.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, so
that the largest product is the smallest distance; scores are products of the original vectors.

Defined results: vectors null, zero, holding null or non-finite components, or of another length than
the commonest (the smaller one if two are) take no part; equal rows count once, and rows of a query's
own id aren't its candidates; ties of a score go to the smaller id; null ids take no part; an empty table, or no
usable query, gives no rows; vectors of any length are taken whole; columns beside vec_id and embedding play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import prepare, read, written
from quillspark.llm.near import groups

LIST_SIZE, MAX_LISTS, MAX_SAMPLE = 1024, 16_384, 65_536
REPLICAS, REPLICA_RATIO = 4, 1.2
#: The share of the sample's own neighbours that the probe ratio must reach, on so many of its rows.
RECALL, TRIALS = 0.975, 400
BLOCK = 2048
#: Parts in which the blocks that a query read are merged before these are.
MERGES = 64
DEGREE, BEAM, EXPAND = 16, 32, 4


@dataclass(frozen=True)
class Centroids:
    points: np.ndarray
    graph: np.ndarray
    largest: float
    ratio: float = 1.0
    probes: int = 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Entries with their further coordinate."""
        rest = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1).astype(np.float32)

    def aim(self, q: np.ndarray) -> np.ndarray:
        """Queries at the entries' scale; the order of products doesn't depend on a query's norm."""
        norm = np.sqrt((q * q).sum(1, keepdims=True))
        return np.concatenate([q / norm * self.largest, np.zeros((len(q), 1))], 1).astype(np.float32)

    def nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the n nearest found for each row, nearest first."""
        parts = [self._walk(x[i : i + 256], n) for i in range(0, len(x), 256)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        k, b = len(self.points), len(x)
        n = min(n, k)
        beam_size = min(k, max(BEAM, 2 * n))
        rows = np.arange(b)[:, None]
        beam = np.broadcast_to(np.linspace(0, k - 1, beam_size).astype(np.int64), (b, beam_size))[:, ::2].copy()
        seen, grown = np.zeros((b, k), bool), np.zeros((b, k), bool)
        seen[rows, beam] = True
        far = self._distance(x, beam)
        while True:
            open_ = np.where(grown[rows, beam], np.inf, far)
            pick = np.argsort(open_, 1, kind="stable")[:, :EXPAND]
            live = np.isfinite(open_[rows, pick])
            if not live.any():
                break
            node = beam[rows, pick]
            grown[rows, node] |= live
            near = self.graph[node].reshape(b, -1)
            new = ~seen[rows, near] & np.repeat(live, self.graph.shape[1], 1)
            seen[rows, near] |= new
            near_far = np.where(new, self._distance(x, near), np.inf)
            # a node named twice in one step would stay twice
            order = np.argsort(near, 1, kind="stable")
            same = np.zeros_like(new)
            named = near[rows, order]
            same[rows, order[:, 1:]] = (named[:, 1:] == named[:, :-1]) & new[rows, order[:, 1:]] & new[rows, order[:, :-1]]
            near_far[same] = np.inf
            beam, far = np.concatenate([beam, near], 1), np.concatenate([far, near_far], 1)
            top = np.argsort(far, 1, kind="stable")[:, :beam_size]
            beam, far = beam[rows, top], far[rows, top]
            grown[rows, np.where(np.isfinite(far), beam, beam[:, :1])] |= ~np.isfinite(far)
        top = np.argsort(far, 1, kind="stable")[:, :n]
        return beam[rows, top], far[rows, top]

    def _distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((self.points[at] - x[:, None, :]) ** 2).sum(2), 0))


def balanced_centroids(x: np.ndarray, size: int, most: int) -> np.ndarray:
    """Means of the leaves of a bisection into halves, until they hold at most ``size`` rows or there are ``most``."""
    leaves = [np.arange(len(x))]
    rng = np.random.default_rng(7)
    while True:
        leaves.sort(key=len)
        if len(leaves[-1]) <= size or len(leaves) >= most:
            break
        own = leaves.pop()
        points = x[own]
        a, b = points[rng.integers(len(own))], points[rng.integers(len(own))]
        for _ in range(6):
            side = points @ (a - b)
            order = np.argsort(side, kind="stable")
            half = len(own) // 2
            a, b = points[order[half:]].mean(0), points[order[:half]].mean(0)
        leaves += [own[order[:half]], own[order[half:]]]
    return np.stack([x[i].mean(0) for i in leaves])


def neighbour_graph(points: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The nearest neighbours of each point, and a few far links that keep the graph in one piece."""
    k = len(points)
    near = min(degree, max(k - 1, 1))
    out = np.zeros((k, near + 4), np.int64)
    norm = (points**2).sum(1)
    for i in range(0, k, 1024):
        d = norm[None, :] - 2 * points[i : i + 1024] @ points.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf if k > 1 else 0
        out[i : i + 1024, :near] = np.argpartition(d, near - 1, 1)[:, :near]
    for j in range(4):  # a ring, and steps of growing powers along it
        out[:, near + j] = (np.arange(k) + max(1, int(k ** (j / 4)))) % k
    return out


def entries_of(vectors: DataFrame, ids: int) -> DataFrame:
    """(embedding, ids): distinct usable vectors with their ``ids`` smallest ids."""
    usable = vectors.filter(F.col("vec_id").isNotNull()).filter(F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)"))
    sizes = usable.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    usable = usable.filter(F.size("embedding") == (sizes[0].n if sizes else 0)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    salted = usable.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for keys in (["embedding", "salt"], ["embedding"]):
        w = Window.partitionBy(*keys).orderBy("vec_id")
        rank = F.row_number() if "salt" in keys else F.dense_rank()  # equal rows have equal salts
        salted = salted.distinct() if "salt" in keys else salted
        salted = salted.withColumn("r", rank.over(w)).filter(F.col("r") <= ids).drop("r")
    return salted.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fit_centroids(entries: DataFrame, list_size: int = LIST_SIZE, max_lists: int = MAX_LISTS, max_sample: int = MAX_SAMPLE) -> Centroids | None:
    stats = entries.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(embedding, 0D, (s, x) -> s + x * x)")).alias("m")).first()
    if not stats.n:
        return None
    rows = entries.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(max_sample).toArrow()
    x = _matrix(rows.column(0).combine_chunks())
    largest = float(np.sqrt(stats.m))
    made = Centroids(np.zeros((0, 0)), np.zeros((0, 0)), largest)
    lists = int(min(max_lists, max(1, -(-stats.n // list_size)), max(1, len(x) // 4)))
    lifted = made.lift(x)
    points = balanced_centroids(lifted, max(1, -(-len(x) // lists)), lists).astype(np.float32)
    return _calibrated(Centroids(points, neighbour_graph(points), largest), x)


def _replicas(c: Centroids, x: np.ndarray, most: int = REPLICAS, ratio: float = REPLICA_RATIO) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each copy."""
    at, far = c.nearest(x, most)
    row, j = np.nonzero(far <= ratio * far[:, :1])
    return row, at[row, j]


def _calibrated(c: Centroids, x: np.ndarray, k: int = 20, recall: float = RECALL, trials: int = TRIALS) -> Centroids:
    """With the ratio, and the number of lists that go with it, that reach the sample's neighbours."""
    step = max(1, len(x) // trials)
    own = np.arange(0, len(x), step)[:trials]
    k = min(k, len(x) - 1)
    if len(c.points) == 1 or k < 1:
        return c
    near = np.zeros((len(own), k), np.int64)
    for i in range(0, len(own), 32):
        product = -(x[own[i : i + 32]] @ x.T)
        product[np.arange(len(product)), own[i : i + 32]] = np.inf
        near[i : i + 32] = np.argpartition(product, k - 1, 1)[:, :k]
    norm = (c.points**2).sum(1)
    q = c.aim(x[own])
    to_lists = np.sqrt(np.maximum((q**2).sum(1)[:, None] + norm[None, :] - 2 * q @ c.points.T, 0))
    need = np.full(near.shape, np.inf)
    row, at = _replicas(c, c.lift(x[near.ravel()]))
    np.minimum.at(need.ravel(), row, to_lists[row // k, at])
    first = np.maximum(to_lists.min(1, keepdims=True), 1e-12)
    ratio = float(np.quantile(need / first, recall))
    probes = int(((to_lists <= ratio * first).sum(1)).max())
    return Centroids(c.points, c.graph, c.largest, ratio, min(len(c.points), max(8, probes)))


def _top(q: np.ndarray, v: np.ndarray, first: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, ids, ends of the queries' parts): the k best ids of entries ``v`` for each row of ``q``.

    Entry e has the ascending ``ids[first[e] : first[e + 1]]``; ties go to smaller ids.
    """
    least = ids[first[:-1]]
    rough = q @ v.T
    if len(v) <= k:
        chosen = [np.arange(len(v))] * len(q)
    else:
        # What reaches the k-th best, give or take what another order of summation may change, ties included.
        floor = -np.partition(-rough, k - 1, 1)[:, k - 1] - 1e-9 * (1 + np.abs(rough).max(1))
        row, column = np.nonzero(rough >= floor[:, None])
        chosen = np.split(column, np.searchsorted(row, np.arange(1, len(q))))
    row = np.repeat(np.arange(len(q)), [len(c) for c in chosen])
    entry = np.concatenate(chosen)
    exact = (v[entry] * q[row]).sum(1)
    order = np.lexsort((least[entry], -exact, row))
    row, entry, exact = row[order], entry[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, entry, exact = (x[rank < k] for x in (row, entry, exact))
    n = first[entry + 1] - first[entry]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[entry], n)
    row, exact, out = np.repeat(row, n), np.repeat(exact, n), ids[at]
    order = np.lexsort((out, -exact, row))
    row, exact, out = row[order], exact[order], out[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return exact[keep], out[keep], np.cumsum(np.bincount(row[keep], minlength=len(q)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, **index) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` of largest inner product found for each row of ``queries``.

    Both have vec_id and embedding; a query's candidates are the rows of other ids.
    """
    spark = vectors.sparkSession
    prepare(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries = written(entries_of(vectors, k + 1))
    c = fit_centroids(entries, **index)
    if c is None:
        return empty
    d = c.points.shape[1] - 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                row, at = _replicas(c, c.lift(_matrix(part.column(0))))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(x.take(pa.array(row)) for x in part.columns)], ["list", "embedding", "ids"])

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                at, far = c.nearest(c.aim(_matrix(part.column(1))), c.probes)
                keep = far <= c.ratio * far[:, :1]
                keep[:, :8] = True
                row, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(at[row, j], pa.int64()), *(x.take(pa.array(row)) for x in part.columns)], ["list", "ask", "embedding"])

    lists = written(entries.mapInArrow(post, "list long, embedding array<double>, ids array<long>"))
    usable = queries.filter(F.col("vec_id").isNotNull() & (F.size("embedding") == d))
    usable = usable.filter(F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)"))
    usable = usable.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    # Equal queries are asked once, under the least of their ids.
    asking = written(usable.groupBy("embedding").agg(F.min("query_id").alias("ask")))
    asked = written(asking.select("ask", "embedding").mapInArrow(aim, "list long, ask long, embedding array<double>"))

    def blocks(rows: DataFrame) -> DataFrame:
        """Blocks of each list: as many rows as there are lists."""
        return rows.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))

    own = F.pmod(F.xxhash64("embedding"), F.col("n")).cast("int")
    sizes = blocks(lists).withColumnRenamed("n", "nv").join(blocks(asked).withColumnRenamed("n", "nq"), "list")
    sizes = F.broadcast(sizes)  # at most max_lists rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "list").withColumn("n", F.col("nq")).select("list", every("nv").alias("vb"), own.alias("qb"), F.lit(0).alias("side"), "ask", "embedding", F.lit(None).cast("array<long>").alias("ids"))
    right = lists.join(sizes, "list").withColumn("n", F.col("nv")).select("list", own.alias("vb"), every("nq").alias("qb"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("ask"), "embedding", "ids")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            n = int((group.column("side").to_numpy() == 0).sum())
            if not n or n == group.num_rows:
                continue
            x = _matrix(group.column("embedding").combine_chunks())
            ask = group.column("ask").slice(0, n).to_numpy()
            own = group.column("ids").slice(n).combine_chunks()
            first, flat = own.offsets.to_numpy().astype(np.int64), own.values.to_numpy()
            for lo in range(0, n, 256):
                scores, ids, ends = _top(x[lo : min(lo + 256, n)], x[n:], first, flat, k + 1)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists_of = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (scores, ids)]
                salt = np.full(len(ends), hash((group.column(0)[0].as_py(), group.column(1)[0].as_py())) % MERGES, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ask[lo : lo + len(ends)]), pa.array(salt), *lists_of], ["ask", "salt", "scores", "ids"])

    rows = left.unionByName(right).repartition("list", "vb", "qb").sortWithinPartitions("list", "vb", "qb", "side")
    found = rows.mapInArrow(score, "ask long, salt int, scores array<double>, ids array<long>")
    # A query has a row for each block that it read. They are merged in two steps, so that none holds what all blocks gave.
    pairs = F.arrays_zip(F.transform("scores", lambda v: -v).alias("s"), F.col("ids").alias("i"))

    def merged(groups_of: DataFrame, *keys: str) -> DataFrame:
        every = groups_of.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("all"))
        # copies of an entry in several lists come side by side, with equal scores
        return every.select(*keys, F.slice(F.expr("filter(all, (x, j) -> j = 0 or x != all[j - 1])"), 1, k + 1).alias("best"))

    lists_of = merged(merged(found.select("ask", "salt", pairs.alias("best")), "ask", "salt"), "ask")
    best = lists_of.join(asking, "ask").select("embedding", "best")
    top = usable.join(best, "embedding").select("query_id", F.slice(F.filter("best", lambda x: x["i"] != F.col("query_id")), 1, k).alias("best"))
    return top.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, against all others."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
