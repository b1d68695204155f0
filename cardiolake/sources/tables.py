"""Samples derived from an event log, for checks and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Events per recording slice: bounds every group that numbers events.
SLICE = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """``record_id, i, fhr, uc``: one series per event type and slice of the event log.

    The heart rate follows a 20-event sum of the values and contains short and long gaps,
    zero runs, out-of-range values, spikes and dips; contractions are triangles.
    """
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    order = Window.partitionBy("event_type", "slice").orderBy("event_id")
    numbered = (
        events.withColumn("slice", F.expr(f"event_id div {SLICE}"))
        .withColumn("i", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("s20", F.sum(F.floor("value")).over(order.rowsBetween(-19, 0)))
        .withColumn("p", F.col("i") % 400)
        .withColumn("c", F.expr("(i div 400) % 3"))
    )
    dip = F.expr(
        "case c when 0 then greatest(0d, 30d - 0.375d * abs(p - 290))"
        " when 1 then greatest(0d, 45d - 0.75d * abs(p - 290)) else 0d end"
    )
    base = numbered.withColumn("base", 130.0 + F.col("s20").cast("double") / 100.0 - dip)
    return base.select(
        F.concat_ws("-", "event_type", F.col("slice").cast("string")).alias("record_id"),
        "i",
        F.expr(
            "case when i % 500 between 100 and 129 then null"
            " when i % 500 between 400 and 449 then 0d"
            " when i % 211 = 7 then 400d"
            " when i % 173 = 11 then base + 40 else base end"
        ).alias("fhr"),
        F.expr("cast(greatest(0, 60 - abs(p - 200)) as double)").alias("uc"),
    )
