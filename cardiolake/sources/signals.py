"""Signal files: interleaved 16-bit little-endian samples, and the samples table."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.sources.headers import channel

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the 16-bit code for "no sample".
MISSING_CODE = -32768

# Frames decoded by one task; files are cut into byte ranges of this many frames.
FRAMES_PER_SPLIT = 1 << 20


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme under which Spark reads it, so tasks open the same files."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and "://" not in full else full


def signal_problems(parsed: DataFrame, folder: str) -> DataFrame:
    """``record_id, error`` of usable headers whose signal file cannot be decoded as it promises.

    Found without reading samples: wanted channels in several files or in another format than 16,
    a missing file, or one shorter than the header's sample count. One file lookup a record.
    """
    root = qualified(parsed.sparkSession, folder).rstrip("/")
    wanted = [channel("signals", name) for name in ("FHR", "FHR2", "UC")]
    files = F.array_distinct(F.array_compact(F.array(*[c.file for c in wanted])))
    formats = F.array_distinct(F.array_compact(F.array(*[c.format for c in wanted])))
    layout = (
        F.when(F.size(files) > 1, F.lit("channels lie in several signal files"))
        .when(F.size(files) == 0, F.lit("no signal file is named"))
        .when(~F.forall(formats, lambda f: f == "16"), F.concat(F.lit("signal format is not 16: "), F.array_join(formats, ", ")))
    )
    rows = parsed.where(F.col("error").isNull() & (F.col("n_samples") > 0)).select(
        "record_id",
        F.concat(F.lit(root + "/"), F.get(files, F.lit(0))).alias("path"),
        (F.col("n_samples") * F.col("n_signals") * 2).cast("long").alias("needed"),
        layout.alias("error"),
    )

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            errors = []
            for r in batch.itertuples(index=False):
                if r.error is not None:
                    errors.append(r.error)
                    continue
                source, path = fs.FileSystem.from_uri(r.path)
                info = source.get_file_info(path)
                if info.type != fs.FileType.File:
                    errors.append("signal file is missing")
                elif info.size < r.needed:
                    errors.append(f"signal file is short: {info.size} of {r.needed} bytes")
                else:
                    errors.append(None)
            yield pd.DataFrame({"record_id": batch["record_id"], "error": errors})

    return rows.mapInPandas(look, "record_id string, error string").where("error is not null")


def signal_splits(parsed: DataFrame, folder: str, frames: int = FRAMES_PER_SPLIT) -> DataFrame:
    """One row per byte range of each record's signal file, with the calibration of its channels.

    Ranges come from the header's sample count, so no file is ever read as a whole and a very
    long recording is decoded by many tasks.
    """
    fhr, uc = channel("signals", "FHR"), channel("signals", "UC")
    fhr2 = channel("signals", "FHR2")
    starts = F.expr(f"sequence(0L, greatest(n_samples - 1, 0L), {frames}L)")
    usable = parsed.where(F.col("error").isNull() & (F.col("n_samples") > 0))
    root = qualified(parsed.sparkSession, folder).rstrip("/")
    return usable.select(
        "record_id",
        F.concat(F.lit(root + "/"), fhr.file).alias("path"),
        "n_signals",
        F.explode(starts).alias("first"),
        "n_samples",
        *[
            column.alias(f"{name}_{part}")
            for name, signal in (("fhr", fhr), ("fhr2", fhr2), ("uc", uc))
            for part, column in (
                ("position", signal.position),
                ("gain", signal.gain),
                ("baseline", signal.baseline),
            )
        ],
    ).withColumn("count", F.least(F.lit(frames).cast("long"), F.col("n_samples") - F.col("first")))


SAMPLE_SCHEMA = "record_id string, i long, fhr double, fhr2 double, uc double"


def _physical(raw: np.ndarray, split) -> pd.DataFrame:
    """Calibrate the wanted channels of ``raw[frames, channels]``."""
    columns = {}
    for name in ("fhr", "fhr2", "uc"):
        position = getattr(split, f"{name}_position")
        if pd.isna(position):
            columns[name] = np.full(len(raw), 0.0 if name == "uc" else np.nan)
            continue
        codes = raw[:, int(position)].astype(np.float64)
        values = (codes - getattr(split, f"{name}_baseline")) / getattr(split, f"{name}_gain")
        columns[name] = np.where(codes == MISSING_CODE, np.nan, values)
    index = int(split.first) + np.arange(len(raw), dtype=np.int64)
    return pd.DataFrame({"record_id": split.record_id, "i": index, **columns})


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        for split in batch.itertuples(index=False):
            width = 2 * int(split.n_signals)
            source, path = fs.FileSystem.from_uri(split.path)
            with source.open_input_file(path) as file:
                data = file.read_at(int(split.count) * width, int(split.first) * width)
            if len(data) < int(split.count) * width:
                raise ValueError(f"{split.path} ends before sample {int(split.first) + int(split.count)}")
            raw = np.frombuffer(data, dtype="<i2")
            yield _physical(raw.reshape(-1, int(split.n_signals)), split)


def _decode_content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for split in batch.itertuples(index=False):
            raw = np.frombuffer(split.content, dtype="<i2").reshape(-1, int(split.n_signals))
            yield _physical(raw, split)


def missing_to_null(samples: DataFrame) -> DataFrame:
    return samples.withColumns(
        {c: F.nanvl(c, F.lit(None).cast("double")) for c in ("fhr", "fhr2", "uc")}
    )


def read_signals(splits: DataFrame) -> DataFrame:
    """``record_id, i, fhr, fhr2, uc`` in physical units; a record without UC gets zeros.

    A file that is missing or ends early fails: ``signal_problems`` tells such records beforehand.
    """
    spread = splits.repartition("record_id", "first")
    return missing_to_null(spread.mapInPandas(_decode, SAMPLE_SCHEMA))


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """As ``read_signals`` for rows that carry their bytes in ``content``."""
    return missing_to_null(blocks.mapInPandas(_decode_content, SAMPLE_SCHEMA))


def as_table(samples: DataFrame, sampling_rate: float = 4.0, with_second: bool = False) -> DataFrame:
    """Record table: ``record_id, timestamp, fhr1, uc[, fhr2]``; a missing UC channel is zero."""
    columns = [
        F.col("record_id"),
        (F.col("i") / F.lit(sampling_rate)).alias("timestamp"),
        F.col("fhr").alias("fhr1"),
        F.col("uc") if "uc" in samples.columns else F.lit(0.0).alias("uc"),
    ]
    if with_second:
        columns.append(F.col("fhr2"))
    return samples.select(*columns)


def record_bucket(record_id, buckets: int = 256):
    return F.pmod(F.xxhash64(record_id), F.lit(buckets))


def write_samples(samples: DataFrame, path: str, buckets: int = 256) -> None:
    """Samples table, partitioned by a hash bucket of the record so lookups read few files."""
    (
        samples.withColumn("bucket", record_bucket("record_id", buckets))
        .repartitionByRange("bucket", "record_id", "i")
        .sortWithinPartitions("bucket", "record_id", "i")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def read_record(spark: SparkSession, path: str, record_id: str, buckets: int = 256) -> DataFrame:
    """One record: the bucket filter prunes partitions, the id filter reaches the scan.

    A record that is not in the table fails with LookupError.
    """
    bucket = spark.range(1).select(record_bucket(F.lit(record_id), buckets)).first()[0]
    found = spark.read.parquet(path).where(
        (F.col("bucket") == bucket) & (F.col("record_id") == record_id)
    )
    if found.isEmpty():
        raise LookupError(f"record {record_id!r} not found in {path}")
    return found.drop("bucket")
