"""Sliding windows as arrays, and as rows for per-window rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardiolake.operators import series
from cardiolake.params import CHUNK, WindowParams


def windows(
    samples: DataFrame,
    params: WindowParams = WindowParams(),
    value: str = "fhr",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """One row per window: bounds, ``values`` and the moments needed to normalise it.

    Samples are gathered once into step-sized arrays; windows concatenate those inside the
    task, so the overlap never goes through a shuffle. A record shorter than a window yields
    one window over all its samples. ``chunk`` is kept for co-located joins.
    """
    if "chunk" not in samples.columns:
        samples = series.with_chunk(samples, size)
    zeroed = F.coalesce(F.col(value), F.lit(0.0))
    unit = series.common_step(params.step, params.window, size)
    buckets = series.step_buckets(
        samples,
        unit,
        value,
        keys,
        size,
        extra=(
            F.avg(zeroed).alias("mean_0"),
            F.var_pop(zeroed).alias("var_0"),
            F.collect_list(F.struct("i", F.col(value).alias("x"))).alias("block"),
        ),
    ).withColumns(
        {
            "block": F.transform(F.array_sort("block"), lambda s: s.x),
            "part": F.struct(
                F.col("n").cast("double").alias("n"),
                F.col("mean_0").alias("m"),
                (F.col("var_0") * F.col("n")).alias("m2"),
            ),
        }
    )
    placed, frame = series.bucket_frames(
        buckets.select(*keys, "bucket", "n", "n_valid", "total", "block", "part"),
        unit,
        params.window,
        keys,
        size,
    )
    fs = F.lit(params.sampling_rate)
    framed = placed.withColumns(
        {
            "n_samples": F.sum("n").over(frame),
            "n_present": F.sum("n_valid").over(frame),
            "sum_present": F.sum("total").over(frame),
            "blocks": F.collect_list("block").over(frame),
            "parts": F.collect_list("part").over(frame),
        }
    )
    whole = F.col("n_samples") == params.window
    only = (F.col("bucket") == 0) & (F.col("n_samples") < params.window)
    start = F.col("bucket") * unit
    starts = start % params.step == 0
    return framed.where(F.col("core") & starts & (whole | only)).select(
        *keys,
        "chunk",
        F.expr(f"bucket * {unit} div {params.step}").alias("w"),
        start.alias("start_idx"),
        (start + F.col("n_samples")).alias("end_idx"),
        (start / fs).alias("start_sec"),
        ((start + F.col("n_samples")) / fs).alias("end_sec"),
        "n_present",
        "sum_present",
        F.flatten("blocks").alias("values"),
        "parts",
    )


def window_bounds(
    samples: DataFrame,
    params: WindowParams = WindowParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """Window keys and bounds without touching sample values."""
    if "chunk" not in samples.columns:
        samples = series.with_chunk(samples, size)
    unit = series.common_step(params.step, params.window, size)
    counted = (
        samples.withColumn("bucket", F.expr(f"i div {unit}"))
        .groupBy(*keys, "chunk", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .drop("chunk")
    )
    placed, frame = series.bucket_frames(counted, unit, params.window, keys, size)
    rows = F.sum("n").over(frame)
    start = F.col("bucket") * unit
    return (
        placed.withColumn("_rows", rows)
        .where("core")
        .where(start % params.step == 0)
        .where((F.col("_rows") == params.window) | ((F.col("bucket") == 0) & (F.col("_rows") < params.window)))
        .select(
            *keys,
            F.expr(f"bucket * {unit} div {params.step}").alias("w"),
            start.alias("start_idx"),
            (start + F.col("_rows")).alias("end_idx"),
            (start / F.lit(params.sampling_rate)).alias("start_sec"),
            ((start + F.col("_rows")) / F.lit(params.sampling_rate)).alias("end_sec"),
        )
    )


def windows_from_length(length: Column, params: WindowParams = WindowParams()) -> Column:
    """Number of windows of a record of known length."""
    return F.when(length < params.window, 1).otherwise(
        F.floor((length - params.window) / params.step) + 1
    )


def prepare(windows_df: DataFrame, params: WindowParams = WindowParams()) -> DataFrame:
    """Add ``prepared``: padded with the mean of present values, missing as zero, then z-scored.

    A spread of at most 1e-8 is only centred. Mean and spread merge the per-step moments, which
    stays exact where a sum of squares would cancel.
    """
    width = params.window
    lacking = F.lit(width) - F.size("values")
    pad = F.when(F.col("n_present") > 0, F.col("sum_present") / F.col("n_present")).otherwise(0.0)
    padded = windows_df.withColumns({"_pad": pad, "_lacking": lacking}).withColumn(
        "_parts",
        F.when(
            F.col("_lacking") > 0,
            F.concat(
                "parts",
                F.array(
                    F.struct(
                        F.col("_lacking").cast("double").alias("n"),
                        F.col("_pad").alias("m"),
                        F.lit(0.0).alias("m2"),
                    )
                ),
            ),
        ).otherwise(F.col("parts")),
    )
    mean = F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p.n * p.m) / width
    padded = padded.withColumn("_mean", mean)
    square = F.aggregate(
        "_parts",
        F.lit(0.0),
        lambda acc, p: acc + p.m2 + p.n * (p.m - F.col("_mean")) * (p.m - F.col("_mean")),
    )
    padded = padded.withColumn("_std", F.sqrt(square / width))
    scale = F.when(F.col("_std") > 1e-8, F.col("_std")).otherwise(1.0)
    full = F.when(
        F.col("_lacking") > 0,
        F.concat("values", F.array_repeat("_pad", F.col("_lacking").cast("int"))),
    ).otherwise(F.col("values"))
    return (
        padded.withColumn("_scale", scale)
        .withColumn(
            "prepared",
            F.transform(
                full,
                lambda x: ((F.coalesce(x, F.lit(0.0)) - F.col("_mean")) / F.col("_scale")).cast("float"),
            ),
        )
        .withColumnRenamed("_mean", "window_mean")
        .withColumnRenamed("_std", "window_std")
        .drop("_pad", "_lacking", "_parts", "_scale")
    )


def window_samples(
    samples: DataFrame,
    params: WindowParams = WindowParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """Long form: every sample once per whole window, re-based to ``i = 0`` and one chunk.

    Rules run inside windows by using ``(*keys, w)`` as their keys.
    """
    if "chunk" not in samples.columns:
        samples = series.with_chunk(samples, size)
    lengths = samples.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    with_length = samples.join(series.per_chunk(lengths, samples, keys), [*keys, "chunk"])
    last = F.expr(f"if(n < {params.window}, 0L, (n - {params.window}) div {params.step})")
    member = F.expr(
        f"sequence(greatest(0L, (i - {params.window} + {params.step}) div {params.step}),"
        f" least(i div {params.step}, _last))"
    )
    reaches = F.expr(
        f"greatest(0L, (i - {params.window} + {params.step}) div {params.step}) <= least(i div {params.step}, _last)"
    )
    return (
        with_length.withColumn("_last", last)
        .where(reaches)
        .withColumn("w", F.explode(member))
        .withColumn("i", F.col("i") - F.col("w") * params.step)
        .withColumn("chunk", F.lit(0).cast("long"))
        .drop("_last", "n")
    )
