"""Centroid clustering of integer vectors by the equal-average equal-variance search.

Centroids lie sorted by the sum of their components (their mean, times the dimension). A vector starts at
its own mean and scans outward to both sides. With s the sum, d the dimension and r the deviation (the
length of a vector less its mean), any centroid c keeps
    distance(v, c) >= (s_v - s_c)^2 / d + (r_v - r_c)^2.
The first term alone grows outward, so once it exceeds the best distance the scan ends; both terms together
pass over single centroids. These tests run in doubles with a margin on the safe side; what they leave is
decided by exact integer distances, and equal distances by the smaller number. So the result is the one of
a full search.

Every round is a Spark job: a partition assigns its vectors and gives one row per (cluster, dimension) with
an exact sum, which an aggregate adds up. The driver holds the centroids only, k x dims integers, and so
does each task. The integer vectors are written to the shared folder once and read again by each round.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component are
left out; a component is limited to 2^19 in size before it becomes an integer, so squared distances fit a
long; an inertia beyond a long counts as the largest long. Repeated ids are rows of their own; a null id
counts as an empty text where ids are hashed. Fewer vectors than k give as many centroids as vectors, none give an empty
table. Other columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.llm.common import col, cut

SCALE, LIMIT = 256, float(1 << 19)
#: Vectors that are searched together.
ROWS = 2048
#: Margins of the tests in doubles: relative, and for a deviation.
MARGIN, DEVIATION = 1e-9, 1e-4
TOP = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null, NaN nor infinite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def integers(df: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, v): the vectors that count, as integers floor(256 x)."""
    vector = col(vector_col).cast("array<double>")
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x, F.lit(LIMIT)), F.lit(-LIMIT)) * SCALE).cast("long"))
    return df.filter((F.size(vector) == dims) & finite(vector)).select(col(id_col).alias("id"), whole.alias("v"))


class Search:
    """Nearest centroids of many vectors at once."""

    def __init__(self, centroids: np.ndarray) -> None:
        sums = centroids.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.centroids, self.sums, self.dims = centroids[self.number], sums[self.number], centroids.shape[1]
        self.deviations = self._deviation(self.centroids, self.sums)
        #: Full distances computed, for tests of the pruning.
        self.computed = 0

    def _deviation(self, v: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return np.sqrt(np.square(v - (sums / self.dims)[:, None]).sum(axis=1))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the nearest centroids, and the squared distances."""
        n, k = len(v), len(self.sums)
        sums = v.sum(axis=1)
        deviations = self._deviation(v, sums)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best, who = np.full(n, TOP), np.full(n, k)
        live = np.arange(n)
        while len(live):
            lo, hi, own = left[live], right[live], sums[live]
            below = np.where(lo >= 0, (own - self.sums[np.maximum(lo, 0)]).astype(float), np.inf)
            above = np.where(hi < k, (self.sums[np.minimum(hi, k - 1)] - own).astype(float), np.inf)
            gap = np.square(np.minimum(below, above)) / self.dims
            open_ = gap <= best[live] * (1 + MARGIN)
            live, gap, down = live[open_], gap[open_], (below <= above)[open_]
            at = np.where(down, left[live], right[live])
            left[live] -= down
            right[live] += ~down
            apart = np.maximum(np.abs(deviations[live] - self.deviations[at]) - DEVIATION, 0)
            fits = gap + np.square(apart) <= best[live] * (1 + MARGIN)
            rows, at = live[fits], at[fits]
            away = v[rows] - self.centroids[at]
            distance, number = np.einsum("ij,ij->i", away, away), self.number[at]
            self.computed += len(rows)
            nearer = (distance < best[rows]) | ((distance == best[rows]) & (number < who[rows]))
            best[rows[nearer]], who[rows[nearer]] = distance[nearer], number[nearer]
        return who, best


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids hash lowest, in order of the hashes."""
    mark = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def step(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, every non-empty centroid to the floor of its mean."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, totals, counts = Search(centroids), np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, v in _blocks(batches, dims):
            who, _ = search.nearest(v)
            order = np.argsort(who, kind="stable")
            found, start = np.unique(who[order], return_index=True)
            totals[found] += np.add.reduceat(v[order], start)
            counts += np.bincount(who, minlength=k)
        full = np.flatnonzero(counts)
        columns = [np.repeat(full, dims), np.tile(np.arange(dims), len(full)), totals[full].ravel(), np.repeat(counts[full], dims)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["cluster", "dim", "total", "n"])

    sums = vectors.mapInArrow(add, "cluster long, dim long, total long, n long").groupBy("cluster", "dim")
    moved = centroids.copy()
    for r in sums.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return moved


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (id, cluster, distance) for rows (id, v)."""
    dims = centroids.shape[1]
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for part, v in _blocks(batches, dims):
            who, best = search.nearest(v)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {kind}, cluster int, distance long")


class Clustering(NamedTuple):
    centroids: np.ndarray
    assigned: DataFrame


def cluster(df: DataFrame, k: int, rounds: int, dims: int, id_col: str = "vec_id", vector_col: str = "embedding", salt: str = "2:") -> Clustering:
    """Final centroids, and rows (id, cluster, distance), after `rounds` rounds and one more assignment."""
    vectors = cut(integers(df, dims, id_col, vector_col))
    centroids = seeds(vectors, k, salt)
    if not len(centroids):
        return Clustering(np.zeros((0, dims), dtype=np.int64), vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    for _ in range(rounds):
        centroids = step(vectors, centroids)
    return Clustering(centroids, assign(vectors, centroids))


def summarised(found: Clustering, id_col: str = "vec_id") -> DataFrame:
    """The assigned rows with the inertia of their cluster and of all, and their centroid's digest.

    The table of clusters has k rows at most and is broadcast.
    """
    assigned = cut(found.assigned)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), TOP)
    rows = [(c, min(s, TOP), total, hashlib.sha256(",".join(map(str, found.centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    clusters = df_of(assigned, rows)
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return assigned.join(F.broadcast(clusters), "cluster").select(F.col("id").alias(id_col), *names)


def df_of(like: DataFrame, rows: list[tuple]) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
