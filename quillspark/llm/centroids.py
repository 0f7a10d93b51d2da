"""Centroid clustering of whole-number vectors, exact to the last digit.

A component x becomes floor(scale * x). Squared distances of a block of rows to all centroids are one matrix
product, |x|^2 - 2 x.c + |c|^2 in float64: with components of at most m and centroids of at most q, every partial
sum is a whole number of at most d (m + q)^2, so while that is below 2^53 the product is exact in any order of
summation. Rows beyond the bound go to 64-bit differences, and beyond 2^63 to Python's integers. A task adds up its
rows by cluster and returns one row; ``treeAggregate`` combines those, so the driver gets one array of clusters x
dimensions however many tasks there are. A round reads the vectors once; nothing of their size is kept between rounds.

Defined results: vectors that are null, of another length or that hold null, NaN or infinite components take no part.
Repeated rows are vectors of their own. A null id seeds only after all others; equal seed digests are taken in order
of components. With fewer vectors than clusters there are fewer clusters; an empty table gives no rows. A distance or an
inertia beyond a long is null (its assignment is exact all the same). ``scale`` is a power of two. Other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import prepare, read, written

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Rows of a matrix product.
BLOCK = 4096
FLOATS, LONGS = 1 << 53, 1 << 63


def complete(vectors: DataFrame, column: str, dimensions: int) -> DataFrame:
    """Rows whose vector has all its components, each a finite number."""
    whole = f"size(`{column}`) = {dimensions} AND forall(`{column}`, x -> coalesce(abs(CAST(x AS DOUBLE)) < double('infinity'), false))"
    return vectors.where(whole)


def integers(values: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, components) of the rows: in 64 bits for those that fit, as Python integers for others."""
    fit = np.abs(values).max(axis=1, initial=0) < float(1 << 60) / scale
    if fit.any():
        yield np.flatnonzero(fit), np.floor(values[fit] * scale).astype(np.int64)
    if not fit.all():
        exact = [[int(v) * scale if abs(v) >= FLOATS else math.floor(v * scale) for v in row] for row in values[~fit].tolist()]
        yield np.flatnonzero(~fit), np.array(exact, dtype=object)


def distances(x: np.ndarray, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, squared distances to each centroid) of rows of whole numbers, by the cheapest arithmetic that is exact for them."""
    reach = max(abs(v) for c in centroids for v in c)
    most = np.abs(x).max(axis=1)

    def bounded(limit: int) -> np.ndarray:
        """Rows with d (m + q)^2 under the limit."""
        return (most <= math.isqrt((limit - 1) // x.shape[1]) - reach).astype(bool)

    rest = np.ones(len(x), dtype=bool)
    if (rows := bounded(FLOATS)).any():
        a, c = x[rows].astype(np.float64), np.array(centroids, dtype=np.float64)
        squares = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
        yield np.flatnonzero(rows), squares.astype(np.int64)
        rest &= ~rows
    for kind, limit in ((np.int64, LONGS), (object, None)):
        rows = rest & bounded(limit) if limit else rest
        if rows.any():
            a, c = x[rows].astype(kind), np.array(centroids, dtype=kind)
            yield np.flatnonzero(rows), np.stack([((a - row) ** 2).sum(axis=1) for row in c], axis=1)
            rest = rest & ~rows


def assigned(values: np.ndarray, centroids: list[list[int]], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, components, cluster, squared distance) of the rows, in parts; ties go to the smaller number."""
    for lo in range(0, len(values), BLOCK):
        for at, x in integers(values[lo : lo + BLOCK], scale):
            for rows, d in distances(x, centroids):
                nearest = d.argmin(axis=1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()])
                yield lo + at[rows], x[rows], nearest, d[np.arange(len(d)), nearest]


def _values(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _add(counts: np.ndarray, sums: np.ndarray, x: np.ndarray, nearest: np.ndarray) -> None:
    """Add rows to the counts and sums of their clusters."""
    k = len(counts)
    counts += np.bincount(nearest, minlength=k)
    top = int(np.abs(x).max())
    if top * len(x) < FLOATS:
        member = (nearest[None, :] == np.arange(k)[:, None]).astype(np.float64)
        sums += (member @ x.astype(np.float64)).astype(np.int64).astype(object)
    else:
        np.add.at(sums, nearest, x.astype(object))


def _moved(vectors: DataFrame, column: str, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Centroids after a round: the floor of the mean of what is nearest to each."""
    k, d = len(centroids), len(centroids[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, d), dtype=object)
        for batch in batches:
            for _, x, nearest, _ in assigned(_values(batch.column(0)), centroids, scale):
                _add(counts, sums, x, nearest)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([[str(v) for v in sums.ravel()]], pa.list_(pa.string()))], names=["n", "total"])

    parts = vectors.select(f"`{column}`").mapInArrow(partial, "n array<bigint>, total array<string>").rdd
    none = ([0] * k, [0] * (k * d))

    def plus(a: tuple, b: tuple) -> tuple:
        return [x + y for x, y in zip(a[0], b[0], strict=True)], [x + int(y) for x, y in zip(a[1], b[1], strict=True)]

    counts, sums = parts.treeAggregate(none, plus, plus, depth=3)
    return [[v // n for v in sums[i * d : (i + 1) * d]] if n else centroids[i] for i, n in enumerate(counts)]


def seeds(vectors: DataFrame, id: str, column: str, clusters: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors with the smallest digests of ``seed:id``, at most ``clusters`` rows."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id}`").cast("string")), 256)
    first = vectors.select(key.alias("key"), F.transform(f"`{column}`", lambda x: x.cast("double")).alias("x")).orderBy(F.asc_nulls_last("key"), "x").limit(clusters).collect()
    out: list[list[int]] = [[] for _ in first]
    for at, x in integers(np.array([r.x for r in first]), scale) if first else ():
        for i, row in zip(at.tolist(), x.tolist(), strict=True):
            out[i] = [int(v) for v in row]
    return out


def clusters_of(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """A written table of (id, cluster, distance), and the final centroids."""
    spark = vectors.sparkSession
    prepare(spark)
    kept = complete(vectors.select(f"`{id}`", f"`{column}`"), column, dimensions)
    centroids = seeds(kept, id, column, clusters, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(kept, column, centroids, scale)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, far = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows, dtype=object)
            for at, _, cluster, distance in assigned(_values(batch.column(1)), centroids, scale):
                number[at], far[at] = cluster, distance
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array([int(v) if v < LONGS else None for v in far], pa.int64())], names=["id", "cluster", "distance"])

    schema = T.StructType([T.StructField(id, vectors.schema[id].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return written(kept.mapInArrow(nearest, schema)), centroids


def clustered(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", **parameters: int) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every complete vector."""
    rows, centroids = clusters_of(vectors, id, column, **parameters)
    total = F.when(F.count(F.lit(1)) == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    by = {r.cluster: r.total for r in rows.groupBy("cluster").agg(total.alias("total")).collect()}
    whole = None if None in by.values() else int(sum(by.values()))
    fits = lambda v: None if v is None or v >= LONGS else int(v)
    sums = [(i, fits(by.get(i, 0)), fits(whole), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    table = rows.sparkSession.createDataFrame(sums, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(f"`{id}`", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # as many rows as clusters


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of sixteen centroids over all vectors."""
    return clustered(read(spark, sf_dir, "embeddings"))


def _sql(dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same rows as SQL: one assignment and one update a round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('{seed}:', CAST(vec_id AS VARCHAR))), e) - 1 AS k, e FROM v ORDER BY sha256(concat('{seed}:', CAST(vec_id AS VARCHAR))), e LIMIT {clusters})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS best FROM (
SELECT r, k, CAST(list_sum(list_transform(generate_series(1, {dimensions}), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS BIGINT) AS d FROM v, c{i} AS c) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS e FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (
SELECT a.best.k AS k, unnest(v.e) AS x, unnest(generate_series(1, {dimensions})) AS i FROM v JOIN a{i} AS a USING (r)) GROUP BY k, i) GROUP BY k)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.e, c.e) AS e FROM c{i} AS c LEFT JOIN m{i} AS m USING (k))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.best.k AS INT) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM v JOIN a{rounds} AS a USING (r) JOIN c{rounds} AS c ON c.k = a.best.k"""


OP11_SQL = _sql()
