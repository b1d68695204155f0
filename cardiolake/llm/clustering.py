"""Centroid clustering over integer vectors, with bounds loosened along the centroids' history (ns-bounds)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardiolake.llm.shared import dropped, new_path, written

# Components beyond this could make a squared distance that no 64-bit number holds.
LARGEST = 1 << 27
# Bounds are doubles of exact integers: this much is given away on both sides against rounding.
_SLACK = 1e-12


@dataclass(frozen=True)
class Clusters:
    rows: DataFrame  # vec_id, cluster, distance
    centroids: list[list[int]]


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, x array<int>): floor(scale * component) of the vectors with exactly ``dim`` finite components.

    NULL vectors, other lengths and NULL or non-finite components are left out. A component whose
    whole number is beyond ``LARGEST`` stops the job: its distances would not fit 64 bits.
    """
    v = F.col("v")
    wide = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = wide.filter(F.coalesce((F.size(v) == dim) & fine, F.lit(False)))
    too_large = F.raise_error(F.lit(f"a vector component beyond {LARGEST / scale}")).cast("int")
    whole = F.transform(v, lambda x: F.when(F.abs(x) <= LARGEST / scale, F.floor(x * scale).cast("int")).otherwise(too_large))
    return kept.select("vec_id", whole.alias("x"))


def first_centroids(points: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ``seed:id`` has the least sha256; a NULL id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = points.select(F.sha2(name.cast("binary"), 256).alias("h"), "x").orderBy("h", "x").limit(k)
    return [list(r["x"]) for r in rows.collect()]  # k rows


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """Bounds of some vectors: an upper one to their own centroid, a lower one to every centroid.

    Each bound is the exact distance at the round it was last evaluated, and that round. It is
    loosened by how far the centroid is now from where it was then, which is never more than the sum
    of its moves in between.
    """

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, since: np.ndarray, lower: np.ndarray, asked: np.ndarray):
        self.cluster, self.upper, self.since, self.lower, self.asked = cluster, upper, since, lower, asked

    @classmethod
    def nothing(cls, n: int, k: int) -> Bounds:
        """Before the first round: no centroid can be ruled out."""
        ints = lambda *shape: np.zeros(shape, np.int32)
        return cls(ints(n), np.full(n, np.inf), ints(n), np.zeros((n, k)), ints(n, k))

    def assign(self, x: np.ndarray, history: np.ndarray) -> None:
        """Give every vector its nearest centroid of the last round, ties to the smaller number.

        A centroid whose loosened lower bound is above the upper bound is farther for certain. Where
        that fails, the own distance is taken anew and then those of the centroids that still fail.
        """
        now = len(history) - 1
        centroids = history[now]
        moved = np.sqrt(((history - centroids).astype(np.float64) ** 2).sum(axis=2))  # (round, centroid)
        k = len(centroids)
        every = np.arange(len(x))
        upper = (self.upper + moved[self.since, self.cluster]) * (1 + _SLACK)
        lower = (self.lower - moved[self.asked, np.arange(k)]) * (1 - _SLACK) - _SLACK
        lower[every, self.cluster] = np.inf
        failed = np.flatnonzero(lower.min(axis=1, initial=np.inf) <= upper)
        if not len(failed):
            return
        own = np.empty(len(failed), np.int64)
        for j in range(k):
            mine = self.cluster[failed] == j
            own[mine] = squared(x[failed[mine]], centroids[j])
        was = self.cluster[failed].copy()
        best, exact = was.copy(), own.copy()
        roots = np.sqrt(own.astype(np.float64))
        self.lower[failed, was], self.asked[failed, was] = roots, now
        open_ = lower[failed] <= (roots * (1 + _SLACK))[:, None]
        for j in range(k):
            rows = np.flatnonzero(open_[:, j])
            if not len(rows):
                continue
            d = squared(x[failed[rows]], centroids[j])
            self.lower[failed[rows], j], self.asked[failed[rows], j] = np.sqrt(d.astype(np.float64)), now
            nearer = (d < exact[rows]) | ((d == exact[rows]) & (j < best[rows]))
            best[rows[nearer]], exact[rows[nearer]] = j, d[nearer]
        self.cluster[failed], self.since[failed] = best, now
        self.upper[failed] = np.sqrt(exact.astype(np.float64))


_STATE = "vec_id long, x array<int>, cluster int, upper double, since int, lower array<double>, asked array<int>"


def _lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(values.ravel()))


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(dtype)


def assigned(state: DataFrame, history: list[list[list[int]]], dim: int) -> DataFrame:
    """The state after one more assignment, to the last centroids of ``history``."""
    past = np.array(history, np.int64)
    k = past.shape[1]
    fresh = "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), dim, np.int64)
            if fresh:
                bounds = Bounds.nothing(len(x), k)
            else:
                flat = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "since")]
                bounds = Bounds(*flat, _matrix(batch.column("lower"), k, np.float64), _matrix(batch.column("asked"), k, np.int32))
            bounds.assign(x, past)
            columns = [
                batch.column("vec_id"), batch.column("x"), pa.array(bounds.cluster), pa.array(bounds.upper),
                pa.array(bounds.since), _lists(bounds.lower), _lists(bounds.asked),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "upper", "since", "lower", "asked"])

    return state.mapInArrow(run, _STATE)


def moved_centroids(state: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """Componentwise floor of the exact mean of each cluster; an empty cluster keeps its centroid."""
    sums = [F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dim)]
    found = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect()  # a row a cluster
    means = {r["cluster"]: [r[f"s{i}"] // r["n"] for i in range(dim)] for r in found}
    return [means.get(j, c) for j, c in enumerate(centroids)]


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dim: int = 64,
    k: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    seed: int = 3,
) -> Clusters:
    """Lloyd's clustering in whole numbers: ``rounds`` of assigning and moving, then one more assignment.

    ``rows`` has vec_id, cluster (0 to k - 1) and distance, the squared Euclidean distance to the final
    centroid. Every step is exact, so reruns and layouts agree. With fewer than k vectors there are as
    many centroids as vectors; without any there are no rows. Vectors that ``whole_numbers`` leaves out
    have no row, repeated rows give repeated rows, NULL ids take part; other columns are ignored.

    The driver holds centroids only: k x dim numbers a round. A round reads and writes each vector with
    its bounds once and the table of the round before is dropped, so at most two lie on disk.
    """
    spark = vectors.sparkSession
    path = new_path(spark, "centroid-points")
    state = written(whole_numbers(vectors, id_col, vector_col, dim, scale), path=path)
    first = first_centroids(state, k, seed)
    if not first:
        return Clusters(state.selectExpr("vec_id", "0 as cluster", "0L as distance"), [])
    history = [first]
    for turn in range(rounds + 1):
        before, path = path, new_path(spark, "centroid-state")
        state = written(assigned(state, history, dim), path=path)
        dropped(spark, before)
        if turn < rounds:
            history.append(moved_centroids(state, history[-1], dim))
    final = F.array(*[F.array(*[F.lit(c) for c in row]) for row in history[-1]])
    apart = F.zip_with("x", final[F.col("cluster")], lambda a, b: (a - b).cast("long"))
    distance = F.aggregate(apart, F.lit(0).cast("long"), lambda total, d: total + d * d)
    return Clusters(state.select("vec_id", "cluster", distance.alias("distance")), history[-1])


def with_inertia(found: Clusters) -> DataFrame:
    """Rows of ``cluster`` with cluster_inertia, inertia and centroid_sha256 (components joined by commas)."""
    spark = found.rows.sparkSession
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    sums = {r["cluster"]: r["s"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    figures = spark.createDataFrame(
        [(j, sums[j], total, name) for j, name in enumerate(names) if j in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.rows.join(F.broadcast(figures), "cluster").select(  # a row a cluster
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
