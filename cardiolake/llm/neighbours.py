"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.llm.shared import written

_BLOCK = 20_000  # points of a bucket that meet in one group
_QUERIES = 4_000  # queries of a bucket that meet in one group


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(-1, n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


class Tables:
    """``count`` hash tables: three rounds of random signs and Hadamard, then the nearest signed axis.

    Bucket 2a is the positive side of axis a, 2a + 1 the negative one.
    """

    def __init__(self, dim: int, count: int, seed: int):
        self.dim, self.count = dim, count
        self.width = 1 << (dim - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (count, 3, self.width))

    def rotated(self, x: np.ndarray, table: int) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        y[:, : self.dim] = x
        for signs in self.signs[table]:
            y = hadamard(y * signs)
        return y

    def buckets(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """(n, probes): the signed axes nearest to each vector, nearest first."""
        y = self.rotated(x, table)
        both = np.stack([y, -y], axis=2).reshape(len(y), -1)
        probes = min(probes, both.shape[1])
        return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part: not NULL or zero, with finite components only."""
    v = F.col("vec")
    wide = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return wide.filter(v.isNotNull() & fine & F.exists(v, lambda x: x != 0.0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _placed(points: DataFrame, tables: Tables, probes: int, chosen: list[int]) -> DataFrame:
    """(table, bucket) of each vector, one row a table and probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), tables.dim)
            for t in chosen:
                b = tables.buckets(x, t, probes)
                row = pa.array(np.repeat(np.arange(len(x)), b.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b.size, t, np.int32)),
                        pa.array(b.ravel().astype(np.int32)),
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                    ],
                    names=["tab", "bucket", "id", "vec"],
                )

    return points.select("id", "vec").mapInArrow(run, "tab int, bucket int, id long, vec array<double>")


def _nearest(points: pa.Table, queries: pa.Table, dim: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The k nearest points of each query: a product finds who can be among them, differences decide."""
    p_ids, q_ids = points["id"].to_numpy(), queries["id"].to_numpy()
    p, q = _matrix(points["vec"].combine_chunks(), dim), _matrix(queries["vec"].combine_chunks(), dim)
    p_norm = (p * p).sum(1)
    for low in range(0, len(q), 256):
        part = q[low : low + 256]
        rough = p_norm[None, :] - 2 * part @ p.T
        for i, own in enumerate(q_ids[low : low + 256]):
            row = rough[i]
            row[p_ids == own] = np.inf
            slack = 1e-9 * (p_norm.max() + (part[i] * part[i]).sum())
            if len(row) > k:
                row_k = np.partition(row, k - 1)[k - 1]
                near = np.flatnonzero(row <= row_k + slack)
            else:
                near = np.arange(len(row))
            near = near[np.isfinite(row[near])]
            d = np.sqrt(((p[near] - part[i]) ** 2).sum(1))
            order = np.lexsort((p_ids[near], d))[:k]
            yield int(own), p_ids[near][order], d[order]


def _search(points: DataFrame, queries: DataFrame, tables: Tables, probes: int, k: int, chosen: list[int]) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest in each bucket that a query probes.

    Points and queries of a bucket meet in blocks of bounded size: a bucket that holds a third of
    all points is many groups, each with every query of the bucket in blocks of its own.
    """
    p = _placed(points, tables, 1, chosen)
    q = _placed(queries, tables, probes, chosen)
    # A count per table and signed axis: bounded by the tables.
    p_n = {(r[0], r[1]): r[2] for r in p.groupBy("tab", "bucket").count().collect()}
    q_n = {(r[0], r[1]): r[2] for r in q.groupBy("tab", "bucket").count().collect()}

    def parts(counts: dict, size: int) -> Column:
        large = [(k, -(-n // size)) for k, n in counts.items() if n > size]
        if not large:
            return F.lit(1)
        pairs = [x for (t, b), n in large for x in (F.lit(f"{t}/{b}"), F.lit(n))]
        return F.coalesce(F.create_map(*pairs)[F.concat_ws("/", "tab", "bucket")], F.lit(1))

    p_parts, q_parts = parts(p_n, _BLOCK), parts(q_n, _QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    p = p.withColumn("pi", mine(p_parts)).withColumn("qi", every(q_parts)).withColumn("query", F.lit(0))
    q = q.withColumn("qi", mine(q_parts)).withColumn("pi", every(p_parts)).withColumn("query", F.lit(1))
    dim = tables.dim

    def meet(group: pa.Table) -> pa.Table:
        flag = group["query"].to_numpy().astype(bool)
        rows = ([], [], [])
        if flag.any() and not flag.all():
            for own, ids, d in _nearest(group.filter(pa.array(~flag)), group.filter(pa.array(flag)), dim, k):
                for column, value in zip(rows, (np.full(len(ids), own), ids, d)):
                    column.append(value)
        joined = [np.concatenate(c) if c else np.zeros(0) for c in rows]
        return pa.table(
            {
                "query_id": pa.array(joined[0].astype(np.int64)),
                "vec_id": pa.array(joined[1].astype(np.int64)),
                "score": pa.array(joined[2].astype(np.float64)),
            }
        )

    names = ["tab", "bucket", "pi", "qi"]
    rows = p.select(*names, "query", "id", "vec").unionByName(q.select(*names, "query", "id", "vec"))
    return rows.groupBy(*names).applyInArrow(meet, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    tables: int = 12,
    probes: int = 10,
    seed: int = 17,
) -> DataFrame:
    """The ``k`` nearest rows found for every row where ``is_query`` holds: (query_id, rank, vec_id, score).

    Score is the Euclidean distance of the original vectors in double precision; ties go to the
    smaller id, and a row is no candidate of a query with its id. Hashing sees directions, so vectors
    should be of about one length. Every row is indexed, in its bucket of each of ``tables``; a query
    probes its ``probes`` nearest signed axes in each. More tables or probes raise recall (measured in
    the tests and the README). A query that finds fewer than ``k`` is searched again over all buckets
    of one table, so it gets all candidates if there are fewer.

    NULL, zero and non-finite vectors, and vectors of another length than the longest, take no part.
    Of equal vectors only the k + 1 least ids are indexed (no more can be among the nearest, or k if
    the query is one of them), so copies make no bucket hot. No rows give no rows.
    """
    fine = usable(vectors.filter(F.col(id_col).isNotNull()), id_col, vector_col)
    dim = fine.agg(F.max(F.size("vec"))).first()[0]
    if dim is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = fine.filter(F.size("vec") == dim)
    copies = Window.partitionBy("vec").orderBy("id")
    points = fine.distinct().withColumn("n", F.row_number().over(copies)).filter(F.col("n") <= k + 1).drop("n")
    chosen = usable(vectors.filter(is_query & F.col(id_col).isNotNull()), id_col, vector_col)
    queries = chosen.filter(F.size("vec") == dim).dropDuplicates(["id"])
    hashed = Tables(dim, tables, seed)
    first = written(_best(_search(points, queries, hashed, probes, k, list(range(tables))), k), "neighbours")
    first = first.select("query_id", "rank", "vec_id", "score")
    full = first.filter(F.col("rank") == k).select("query_id")
    short = queries.join(full, queries["id"] == full["query_id"], "left_anti")
    if short.isEmpty():
        return first
    again = _best(_search(points, short, hashed, 2 * hashed.width, k, [0]), k)
    whole = first.join(full, "query_id", "left_semi")
    return whole.unionByName(again.select("query_id", "rank", "vec_id", "score"))
