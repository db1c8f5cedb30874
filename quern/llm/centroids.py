"""Centroid clustering of whole-number vectors by Lloyd's rounds with annulus search.

Components become floor(scale * x), so distances and means are exact and the
result does not depend on how rows are dealt out.  In each round a task sorts
nothing but the k centroids, by norm.  For each vector it takes the centroids
next to the vector's norm on either side; the nearer one gives an upper bound u
on the distance to the nearest.  As | |x| - |c| | <= |x - c|, only centroids
with norms from |x| - u to |x| + u (both included) can be as near: two binary
searches find that annulus, and its centroids are compared exactly, ties going
to the smaller number.  No bound is kept from round to round, so a lost task is
simply run again.

A task hands on one row a centroid (count and sums); the driver holds k
centroids and their sums, whatever the number of vectors.

Cases: vectors null, of another dimension, or with null or non-finite components
take no part; repeated rows count each; vectors without id take part but are the
last to be picked as a first centroid (ties of the pick go by the vector); with
fewer vectors than k, there are fewer centroids; an empty table gives no rows; a
component beyond ``MOST`` after scaling is refused, since distances would not
fit a long; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import written
from .vectors import matrix, sound

MOST = 1 << 27
ROWS = 1 << 14  # vectors compared at a time


def _gridded(scale: int):
    def run(batches):
        for batch in batches:
            x = np.floor(scale * matrix(batch.column("v"))) if len(batch) else np.zeros((0, 1))
            if len(x) and np.abs(x).max() > MOST:
                raise ValueError(f"a component is beyond {MOST} / {scale}")
            ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(ends, x.astype(np.int64).ravel())], ["vec_id", "v"])

    return run


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class Annuli:
    """The k centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray) -> None:
        norm = np.sqrt(squares(centroids).astype(float))
        self.number = np.argsort(norm, kind="stable")
        self.norm, self.at = norm[self.number], centroids[self.number]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance to it, how many distances were computed)."""
        norm, k = np.sqrt(squares(x).astype(float)), len(self.at)
        above = np.searchsorted(self.norm, norm)
        sides = [np.clip(above - 1, 0, k - 1), np.clip(above, 0, k - 1)]
        bound = np.minimum(*[squares(x - self.at[s]) for s in sides])
        u = np.sqrt(bound.astype(float))
        slack = 1e-9 * (norm + u) + 1e-9  # of the floating-point norms; a centroid too many does no harm
        low, high = np.searchsorted(self.norm, norm - u - slack, "left"), np.searchsorted(self.norm, norm + u + slack, "right")
        best, who, done = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), k), 2 * len(x)
        for p in range(k):
            rows = np.flatnonzero((low <= p) & (p < high))
            d = squares(x[rows] - self.at[p])
            done += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (self.number[p] < who[rows]))
            best[rows[better]], who[rows[better]] = d[better], self.number[p]
        return who, best, done


def _blocks(batches, annuli: Annuli):
    """(batch, x, number, distance) of slices of the stream."""
    for batch in batches:
        for a in range(0, len(batch), ROWS):
            part = batch.slice(a, ROWS)
            x = matrix(part.column("v"))
            who, best, _ = annuli.nearest(x)
            yield part, x, who, best


def _summed(centroids: np.ndarray):
    def run(batches):
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x, who, _ in _blocks(batches, Annuli(centroids)):
            count += np.bincount(who, minlength=len(centroids))
            order = np.argsort(who, kind="stable")
            found, first = np.unique(who[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], first, axis=0)
        some = np.flatnonzero(count)
        if len(some):
            ends = np.arange(len(some) + 1, dtype=np.int32) * sums.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.ListArray.from_arrays(ends, sums[some].ravel())], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for part, _, who, best in _blocks(batches, Annuli(centroids)):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(who.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    return run


def clustered(rows: DataFrame, k: int = 8, dim: int = 64, scale: int = 1024, rounds: int = 10, salt: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector of rows (vec_id, embedding, ...)."""
    spark = rows.sparkSession
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(sound("v") & (F.size("v") == dim))
    grid = written(kept.mapInArrow(_gridded(scale), "vec_id long, v array<long>"), "grid")
    lot = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    centroids = np.array([r["v"] for r in grid.orderBy(lot.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64).reshape(-1, dim)
    for _ in range(rounds if len(centroids) else 0):
        part = grid.mapInArrow(_summed(centroids), "cluster long, n long, sums array<long>")
        exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(str(i)) for i in range(dim)]
        for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # a row a centroid
            centroids[r["cluster"]] = [int(r[str(i)]) // r["n"] for i in range(dim)]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id long, {schema.replace(', ', ', distance long, ', 1)}")
    found = written(grid.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    within = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a centroid
    name = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    each = spark.createDataFrame([(int(c), d, sum(within.values()), name(centroids[c])) for c, d in within.items()], schema)
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
