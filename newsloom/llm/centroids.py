"""Centroid clustering with a bisector tournament.

Vectors become integers, so that every comparison is exact. For two centroids a < b the points
nearer to b lie on one side of their bisector: with the normal 2 * (b - a) and the threshold
|b|^2 - |a|^2, b is nearer exactly if x . normal > threshold. Normals and thresholds of all
pairs are computed once a round and broadcast (k * k * 65 integers); a vector then meets k - 1 linear
sign tests, each of which eliminates one centroid, zero favouring the smaller number. Only the distance
to the winner is computed. Tasks fold their vectors into one row of sums for each cluster.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.scratch import settle

DIMS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
# Integers up to this size keep every product, sum and distance of 64 components within a long.
LARGEST = 1 << 27
# Vectors a task works on at once.
BLOCK = 4096


class Bisectors:
    """The normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]], dims: int):
        self.centroids = np.array(centroids, np.int64).reshape(-1, dims)
        squares = (self.centroids * self.centroids).sum(axis=1)
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row, the smaller one of equally near ones."""
        best = np.zeros(len(vectors), np.int64)
        for other in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", vectors, self.normals[best, other])
            best[side > self.thresholds[best, other]] = other
        return best

    def distance(self, vectors: np.ndarray, best: np.ndarray) -> np.ndarray:
        apart = vectors - self.centroids[best]
        return np.einsum("ij,ij->i", apart, apart)


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[np.ndarray]:
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for at in range(0, len(flat), BLOCK):
        yield flat[at:at + BLOCK].astype(np.int64)


def _folder(held, dims: int):
    """Each task's count and componentwise sums of the vectors of each centroid."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        sums = np.zeros((len(known.centroids), dims + 1), np.int64)
        for batch in batches:
            for block in _blocks(batch, dims):
                best = known.nearest(block)
                for c in np.unique(best):
                    mine = block[best == c]
                    sums[c, :dims] += mine.sum(axis=0)
                    sums[c, dims] += len(mine)
        some = np.flatnonzero(sums[:, dims])
        at = np.tile(np.arange(dims + 1), len(some))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, dims + 1), pa.int32()), pa.array(at, pa.int32()),
             pa.array(sums[some].ravel(), pa.int64())], names=["c", "i", "total"])

    return fold


def _assigner(held, dims: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            best, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for block in _blocks(batch, dims):
                best.append(known.nearest(block))
                far.append(known.distance(block, best[-1]))
            best, far = np.concatenate(best), np.concatenate(far)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(far, pa.int64())],
                names=["vec_id", "cluster", "distance"])

    return assign


def integers(embedding: Column, dims: int = DIMS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component of a vector of ``dims`` finite components, else NULL."""
    limit = float(LARGEST)

    def whole(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        # Beyond this the contract's distance is no long: better an error than a wrong number.
        return F.when(F.abs(scaled) <= limit, F.floor(scaled).cast("int")).otherwise(
            F.raise_error(F.lit(f"a component is too large for exact distances: over {limit:.0f} after scaling")))

    finite = F.forall(embedding, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when((F.size(embedding) == dims) & finite, F.transform(embedding, whole))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(key.asc_nulls_last(), "v").limit(clusters).collect()
    return [list(r["v"]) for r in first]


def next_centroids(vectors: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """One round: exact floored means of the vectors nearest to each centroid; one without any stays."""
    held = vectors.sparkSession.sparkContext.broadcast(Bisectors(centroids, dims))
    partial = vectors.select("v").mapInArrow(_folder(held, dims), "c int, i int, total long")
    sums = partial.groupBy("c", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    # At most clusters * (dims + 1) rows.
    found = {(r["c"], r["i"]): int(r["total"]) for r in sums.collect()}
    held.unpersist()
    return [
        [found[c, i] // found[c, dims] for i in range(dims)] if (c, dims) in found else old
        for c, old in enumerate(centroids)]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
            dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """One row per kept row of ``vectors`` (vec_id, embedding; other columns are ignored): vec_id,
    cluster, distance (squared, in integers), cluster_inertia, inertia and centroid_sha256.

    Vectors that are NULL, have another number of components, or one that is NULL or not finite are
    left out; so a table of none, or an empty one, gives no rows. A NULL vec_id is kept and comes last
    among the first centroids. Repeated rows are vectors of their own: equal ones get the same
    cluster, and of equal centroids the larger number stays empty. Fewer vectors than clusters make
    as many clusters as vectors. Components whose scaled size is over 2**27 raise an error.
    """
    spark = vectors.sparkSession
    kept = settle(vectors.select("vec_id", integers(F.col("embedding"), dims, scale).alias("v")).where("v IS NOT NULL"))
    centroids = first_centroids(kept, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(kept, centroids, dims)
    schema = T.StructType([kept.schema["vec_id"], T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])
    held = spark.sparkContext.broadcast(Bisectors(centroids, dims))
    assigned = settle(kept.mapInArrow(_assigner(held, dims), schema))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    named = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    # At most as many rows as clusters, and one for all of them.
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = assigned.agg(F.sum("distance").alias("inertia")).first()["inertia"]
    return assigned.join(F.broadcast(inertia), "cluster").join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia",
        F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
