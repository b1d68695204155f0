"""Tables shared by several branches of a job, written once to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Staged tables and files that have not been released: (session, table, path).
_WRITTEN: list[tuple[SparkSession, str | None, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only for local sessions that set none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    folder = tempfile.mkdtemp(prefix="cardiolake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(
    df: DataFrame,
    by: Sequence[str] = ("record_id", "chunk"),
    sort: Sequence[str] = ("record_id", "chunk", "i"),
    buckets: int | None = None,
) -> DataFrame:
    """Write ``df`` bucketed and sorted by its processing key and read it back.

    Readers keep the bucket layout: later joins, windows and aggregates on ``by`` move no
    sample again, each reads only its columns, and lost executors do not replay the cleaning.
    ``buckets`` is the caller's, else ``spark.sql.shuffle.partitions``: the plan does not depend on
    data sizes, the master or an estimate. Tables stay until ``release`` or the end of ``scope``.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"staged_{uuid.uuid4().hex}"
    (
        df.repartition(count, *by)
        .write.bucketBy(count, *by)
        .sortBy(*sort)
        .option("path", f"{folder}/{name}")
        .saveAsTable(name)
    )
    _WRITTEN.append((spark, name, f"{folder}/{name}"))
    return spark.table(name)


def written(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared folder: cuts lineage and survives lost executors. Dropped like tables."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written_{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, None, path))
    return spark.read.schema(df.schema).parquet(path)


def release(start: int = 0) -> None:
    """Drop the tables staged since ``start`` and their files; what reads them must be done."""
    while len(_WRITTEN) > start:
        spark, name, path = _WRITTEN.pop()
        if name:
            spark.sql(f"drop table if exists {name}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope() -> Iterator[None]:
    """Tables staged inside are dropped at the end, when the job's results are written."""
    start = len(_WRITTEN)
    try:
        yield
    finally:
        release(start)
