"""Centroid clustering of vectors with a LAESA pivot table.

Vectors become whole numbers, so that every distance and every mean is exact
and the clusters do not depend on how the rows are dealt.

1. The first centroids are the kept vectors with the smallest hashes of their
   ids (a top-k per task, k rows on the driver).
2. Some of them, far from each other, are the pivots.  Each vector's distances
   to the pivots are computed once and written beside the vector.
3. In each round a task gets the centroids and the centroids' distances to the
   pivots.  For every pivot p, |d(v, p) - d(c, p)| <= d(v, c): the largest of
   these is a lower bound, and centroids are tried in its order.  One whose bound is
   above the best exact distance so far is left; the others get their exact
   distance in integers.  The bound is lowered by more than the rounding of
   the roots, so a centroid that ties is never left.
4. A task sends one row of sums for each cluster; k rows come to the driver.

Memory and skew: a task holds one Arrow batch, the centroids and k rows of sums.
Nothing is grouped by cluster but those rows, so a cluster with a third of all
vectors, or one vector a third of all rows, costs no task more than another.
The rounds read the written table; a lost executor costs its tasks only.

Cases: vectors of another length, null ones, and those with a null, NaN or
infinite component are left out.  An empty table gives no rows.  Fewer
vectors than centroids: as many centroids as vectors.  Equal vectors go to the
same cluster; rows with one id are all kept.  A null id is hashed as the text
``null``; rows whose ids are equal go by their vectors.  Ties between
centroids go to the smaller number.  Components are cut to +-2**27 after
scaling, so that a distance fits a long (exact for |x| < 2**27 / scale).  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import importable, written

#: largest scaled component: 64 squares of differences stay below 2**63
MOST = 1 << 27
LONG = (1 << 63) - 1
#: relative and absolute rounding of the roots, with much room
ROUNDING = 1e-9


def quantised(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """_id, _q: the whole-numbered vectors that are kept."""
    x = F.col(vector)
    usable = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (
        F.abs(v.cast("double")) < float("inf")))

    def whole(v: Column) -> Column:
        return F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(float(-MOST))),
                               F.lit(float(MOST)))).cast("int")

    return vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.col(vec_id).alias("_id"), F.transform(x, whole).alias("_q"))


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hashes of ``seed:id``, in hash order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"),
                                                         F.lit("null"))), 256)
    rows = kept.select("_q", name.alias("h")).orderBy("h", "_q").limit(k).collect()
    return np.array([r["_q"] for r in rows], dtype=np.int64)


def far_apart(centroids: np.ndarray, n: int) -> np.ndarray:
    """n of the rows as pivots: each next one is farthest from those taken."""
    taken = [0]
    nearest = ((centroids - centroids[0]) ** 2).sum(1)
    while len(taken) < min(n, len(centroids)):
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((centroids - centroids[taken[-1]]) ** 2).sum(1))
    return centroids[taken]


def roots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all points to all pivots."""
    return np.stack([np.sqrt(((points - p) ** 2).sum(1).astype(np.float64)) for p in pivots], 1)


def nearest(points: np.ndarray, table: np.ndarray, centroids: np.ndarray,
            centroid_table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, exact squared distance, and how many exact distances
    were computed, for each point; the tables hold distances to the pivots."""
    n, k = len(points), len(centroids)
    bound = np.zeros((n, k))
    for p in range(table.shape[1]):
        np.maximum(bound, np.abs(table[:, p, None] - centroid_table[None, :, p]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(n, LONG, dtype=np.int64)
    who = np.full(n, k, dtype=np.int64)
    exact = np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    for j in range(k):
        c = order[rows, j]
        # bounds only grow along the order: what leaves here never comes back
        alive = bound[rows, c] * (1 - ROUNDING) - ROUNDING <= np.sqrt(best[rows].astype(np.float64))
        rows, c = rows[alive], c[alive]
        if not len(rows):
            break
        d = ((points[rows] - centroids[c]) ** 2).sum(1)
        exact[rows] += 1
        better = (d < best[rows]) | ((d == best[rows]) & (c < who[rows]))
        best[rows[better]], who[rows[better]] = d[better], c[better]
    return who, best, exact


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def pivot_table(kept: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """_id, _q, _d: each vector with its distances to the pivots, written once."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = roots(_matrix(batch.column(1), dims, np.int64), pivots)
            at = np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, d.ravel())],
                names=["_id", "_q", "_d"])

    kind = kept.schema["_id"].dataType.simpleString()
    return written(kept.mapInArrow(add, f"_id {kind}, _q array<int>, _d array<double>"), "pivots")


def sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> list:
    """Rows (cluster, n, components' sums) of all vectors at their nearest
    centroids: one row of each cluster from a task, k rows in all."""
    k, dims = centroids.shape
    centroid_table = roots(centroids, pivots)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            points = _matrix(batch.column(0), dims, np.int64)
            who, _, _ = nearest(points, _matrix(batch.column(1), len(pivots), np.float64),
                                centroids, centroid_table)
            np.add.at(total, who, points)
            count += np.bincount(who, minlength=k)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(count[at]),
             pa.array(list(total[at]), pa.list_(pa.int64()))], names=["c", "n", "s"])

    parts = table.select("_q", "_d").mapInArrow(add, "c int, n long, s array<long>")
    return parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(
        *[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s")).collect()


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """_id, cluster, distance, n_exact."""
    dims, centroid_table = centroids.shape[1], roots(centroids, pivots)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, best, exact = nearest(
                _matrix(batch.column(1), dims, np.int64),
                _matrix(batch.column(2), len(pivots), np.float64), centroids, centroid_table)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(who, pa.int32()), pa.array(best),
                 pa.array(exact, pa.int32())], names=["_id", "cluster", "distance", "n_exact"])

    kind = table.schema["_id"].dataType.simpleString()
    return table.select("_id", "_q", "_d").mapInArrow(
        add, f"_id {kind}, cluster int, distance long, n_exact int")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, vec_id: str = "vec_id",
            vector: str = "embedding", dims: int = 64, scale: int = 64, n_pivots: int = 8,
            seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, n_exact, cluster_inertia, inertia, centroid
    (components) and n_vectors (of the cluster), a row for each kept vector."""
    spark = vectors.sparkSession
    importable(spark)
    kept = written(quantised(vectors, vec_id, vector, dims, scale), "quantised")
    centroids = first_centroids(kept, k, seed)
    kind = kept.schema["_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"{vec_id} {kind}, cluster int, distance long, "
                                         "n_exact int, cluster_inertia long, inertia long, "
                                         "centroid array<int>, n_vectors long")
    pivots = far_apart(centroids, n_pivots)
    table = pivot_table(kept, pivots, dims)
    for _ in range(rounds):
        centroids = centroids.copy()
        for row in sums(table, centroids, pivots):
            centroids[row["c"]] = [s // row["n"] for s in row["s"]]
    result = written(assigned(table, centroids, pivots), "clusters")
    inertia = {r["cluster"]: (r["n"], int(r["d"])) for r in result.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(20,0)")).alias("d"))
        .collect()}
    whole = min(sum(d for _, d in inertia.values()), LONG)
    each = spark.createDataFrame(
        [(c, min(d, LONG), whole, centroids[c].tolist(), n) for c, (n, d) in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid array<int>, n_vectors long")
    return result.withColumnRenamed("_id", vec_id).join(F.broadcast(each), "cluster").select(
        vec_id, "cluster", "distance", "n_exact", "cluster_inertia", "inertia", "centroid",
        "n_vectors")
