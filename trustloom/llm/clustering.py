"""Centroid clustering (k-means) in exact integers over an incrementally kept distance matrix.

Every vector becomes integers, floor(scale * x), and keeps its dot product with every centroid in a table of the shared folder. A round
changes a dot product by the changed components of its centroid alone, dot += sum of x_i * change_i, and takes the
nearest centroid anew from |x|^2 - 2 dot + |c|^2. New centroids come from sums per task and cluster, added up by Spark; only the
k centroids and their sums, never vectors, meet on the driver.

Defined cases: null vectors, those with another number of components, and those with a null, NaN or infinite component are left out.
Rows that repeat a vec_id are vectors of their own; a null vec_id is hashed as an empty string. Of the first centroids' hash ties
the smaller components come first. Fewer vectors than k give as many centroids; no vectors, no rows. Ties of distance go
to the smaller centroid number. Components beyond +-2^24 after scaling are refused with an error, as sums of their squares could leave
64 bits. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CENTROIDS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
LARGEST = 1 << 24

STATE = "vec_id long, x array<long>, norm long, dots array<long>, cluster int, distance long"


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), wide)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, wide = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * wide), pa.array(np.ascontiguousarray(matrix).ravel()))


def _nearest(norm: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = norm[:, None] - 2 * dots + (centroids**2).sum(axis=1)
    cluster = far.argmin(axis=1)
    return cluster.astype(np.int32), far[np.arange(len(far)), cluster]


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the integer components, of the vectors that are whole."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).filter((F.size("x") == dimensions) & finite)

    def whole(v):
        return F.when(F.abs(v * scale) <= LARGEST, F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact sums")).cast("long"))

    return rows.select("vec_id", F.transform("x", whole).alias("x"))


def first_centroids(kept: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors with the smallest sha256 of 1:<vec_id>."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()
    return np.array([r.x for r in rows], dtype=np.int64)


def _begin(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), centroids.shape[1])
                norm, dots = (x**2).sum(axis=1), x @ centroids.T
                cluster, distance = _nearest(norm, dots, centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(norm), _lists(dots), pa.array(cluster), pa.array(distance)], names=["vec_id", "x", "norm", "dots", "cluster", "distance"])

    return run


def _move(old: np.ndarray, new: np.ndarray):
    changed = [np.flatnonzero(row) for row in new - old]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, norm, dots = _matrix(batch.column("x"), old.shape[1]), batch.column("norm").to_numpy(), _matrix(batch.column("dots"), len(old)).copy()
                for j, at in enumerate(changed):
                    if len(at):
                        dots[:, j] += x[:, at] @ (new[j, at] - old[j, at])
                cluster, distance = _nearest(norm, dots, new)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), batch.column("norm"), _lists(dots), pa.array(cluster), pa.array(distance)], names=["vec_id", "x", "norm", "dots", "cluster", "distance"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cluster = batch.column("cluster").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(cluster), -1)
            here = np.unique(cluster)
            total = np.stack([x[cluster == c].sum(axis=0) for c in here])
            at = np.tile(np.arange(x.shape[1], dtype=np.int32), len(here))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(here, x.shape[1])), pa.array(at), pa.array(total.ravel()), pa.array(np.repeat([(cluster == c).sum() for c in here], x.shape[1]))], names=["cluster", "at", "total", "n"])


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; empty clusters keep their centroid."""
    found = centroids.copy()
    rows = state.select("cluster", "x").mapInArrow(_sums, "cluster int, at int, total long, n long").groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    for r in rows.collect():  # k times the number of dimensions
        found[r.cluster, r.at] = r.total // r.n
    return found


def assign(kept: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Every vector with its dot products, cluster and distance after the rounds, and the final centroids."""
    state = cut(kept.mapInArrow(_begin(centroids), STATE))
    for _ in range(rounds):
        new = _means(state, centroids)
        state, centroids = cut(state.mapInArrow(_move(centroids, new), STATE)), new
    return state, centroids


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vector_col, dimensions, scale)
    centroids = first_centroids(kept, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state, centroids = assign(kept, centroids, rounds)
    inertia = {r.cluster: r.inertia for r in state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # at most k
    named = [(j, n, sum(inertia.values()), sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, n in inertia.items()]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
