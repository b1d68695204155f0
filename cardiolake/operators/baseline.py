"""Baseline heart rate: the steadiest two-minute window of a record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardiolake.functions import scalar
from cardiolake.operators import series
from cardiolake.params import CHUNK, BaselineParams, WindowParams


def baseline_windows(
    samples: DataFrame,
    params: BaselineParams = BaselineParams(),
    value: str = "fhr",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """One row per start bucket: whole windows carry ``range`` and ``mean`` of valid samples.

    Every bucket row also keeps its own figures, so the per-record fallback needs no second pass.
    """
    samples = samples if "chunk" in samples.columns else series.with_chunk(samples, size)
    unit = series.common_step(params.step, params.window, size)
    buckets = series.step_buckets(samples, unit, value, keys, size)
    placed, frame = series.bucket_frames(buckets, unit, params.window, keys, size)
    starts = F.col("bucket") * unit % params.step == 0
    valid = F.sum("n_valid").over(frame)
    whole = F.sum("n").over(frame) == params.window
    return (
        placed.withColumns(
            {
                "_whole": starts & whole & (valid >= params.window * params.min_valid_ratio),
                "range": F.max("high").over(frame) - F.min("low").over(frame),
                "mean": F.sum("total").over(frame) / valid,
                "start_idx": F.col("bucket") * unit,
            }
        )
        .where("core")
        .withColumn("stable", F.col("_whole") & (F.col("range") < params.max_range))
        .drop("chunk", "core")
    )


def baseline(
    samples: DataFrame,
    params: BaselineParams = BaselineParams(),
    value: str = "fhr",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """Baseline per record; smallest range wins, the earliest window on ties.

    Without a stable window the mean of all valid samples is used with confidence 0.5; a record
    without any valid sample yields 140 with confidence 0.
    """
    windows = baseline_windows(samples, params, value, keys, size)
    summary = windows.groupBy(*keys).agg(
        F.min(F.when(F.col("stable"), F.struct(*_BEST))).alias("best"),
        F.sum("n_valid").alias("n_valid"),
        F.sum("total").alias("total"),
        (F.max("high") - F.min("low")).alias("spread"),
    )
    return baseline_row(summary, params, keys)


def baseline_inside(
    samples: DataFrame,
    window: WindowParams = WindowParams(),
    params: BaselineParams = BaselineParams(),
    value: str = "fhr",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """``baseline`` of every sliding window, keyed by ``(*keys, w)`` with ``chunk`` and bounds.

    Overlapping windows share their two-minute windows: those are found once for the whole series and
    each window takes the best of the ones inside it from a frame of buckets, so no sample is repeated.
    """
    if window.step % params.step:
        raise ValueError(f"windows start every {window.step} samples, off the grid of {params.step}")
    unit = series.common_step(params.step, params.window, size)
    inner = baseline_windows(samples, params, value, keys, size)
    placed, whole, frame = series.window_frames(inner, unit, window.window, window.step, keys, size)
    fitting = frame.rowsBetween(0, max(0, (window.window - params.window) // unit))
    best = F.when(F.col("stable") & F.lit(params.window <= window.window), F.struct(*_BEST))
    framed = placed.withColumns(
        {
            "best": F.min(best).over(fitting),
            "_valid": F.sum("n_valid").over(frame),
            "_total": F.sum("total").over(frame),
            "spread": F.max("high").over(frame) - F.min("low").over(frame),
        }
    ).where(whole)
    bounds = ["chunk", "w", "window_start", "window_end"]
    summary = framed.select(
        *keys, *bounds, F.col("_valid").alias("n_valid"), F.col("_total").alias("total"), "spread",
        F.when(F.col("best").isNotNull(), F.struct(
            F.col("best.range").alias("range"), (F.col("best.start_idx") - F.col("window_start")).alias("start_idx"), F.col("best.mean").alias("mean")
        )).alias("best"),
    )
    return baseline_row(summary, params, [*keys, *bounds])


_BEST = ("range", "start_idx", "mean")


def baseline_row(summary: DataFrame, params: BaselineParams, keys: Sequence[str]) -> DataFrame:
    """The result row of ``best`` (if any), ``n_valid``, ``total`` and ``spread``."""
    found = F.col("best").isNotNull()
    empty = F.col("n_valid") == 0
    raw = F.when(found, F.col("best.mean")).otherwise(F.col("total") / F.col("n_valid"))
    rounded = F.when(empty, F.lit(140.0)).otherwise(scalar.nearest_5(raw))
    flags = scalar.baseline_flags(F.col("value"))
    return (
        summary.withColumn("value", rounded)
        .withColumns(flags)
        .select(
            *keys,
            "value",
            *flags,
            found.alias("stable_segment_found"),
            F.col("best.start_idx").alias("segment_start_idx"),
            F.when(found, F.col("best.range")).otherwise(F.col("spread")).alias("segment_variability"),
            F.when(found, 1.0 - F.col("best.range") / params.max_range)
            .when(empty, 0.0)
            .otherwise(0.5)
            .alias("confidence"),
        )
    )
