"""From a folder of recordings to tables: records, labels, samples and a quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.sources import headers, signals


def ingest(
    spark: SparkSession, folder: str, path: str, limit: int | None = None, buckets: int = 256
) -> dict[str, DataFrame]:
    """Write ``records``, ``labels``, ``quarantine`` and ``samples`` below ``path`` and read them back.

    Unusable headers and signal files (missing, short, of another format, or spread over several
    files) never stop the job; their records are listed with the error and have no samples. A folder
    without any header gives empty tables.
    """
    out = path.rstrip("/")
    found = headers.first_records(headers.read_headers(spark, folder), limit)
    headers.parse_headers(found).write.mode("overwrite").parquet(f"{out}/headers")
    parsed = spark.read.parquet(f"{out}/headers")
    headers.outcome_labels(found).write.mode("overwrite").parquet(f"{out}/labels")
    headers.clinical_metadata(parsed.where(F.col("error").isNull())).write.mode("overwrite").parquet(
        f"{out}/records"
    )
    unusable = parsed.where(F.col("error").isNotNull()).select("record_id", "error")
    unusable.unionByName(signals.signal_problems(parsed, folder)).write.mode("overwrite").parquet(f"{out}/quarantine")
    broken = spark.read.parquet(f"{out}/quarantine").select("record_id").distinct()
    splits = signals.signal_splits(parsed.join(broken, "record_id", "left_anti"), folder)
    signals.write_samples(signals.read_signals(splits), f"{out}/samples", buckets)
    return {
        "records": spark.read.parquet(f"{out}/records"),
        "labels": spark.read.parquet(f"{out}/labels"),
        "quarantine": spark.read.parquet(f"{out}/quarantine"),
        "samples": signals.read_samples(spark, f"{out}/samples"),
    }
