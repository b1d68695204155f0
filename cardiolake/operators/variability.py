"""Beat-to-beat variability: mean range of overlapping one-minute windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardiolake.functions import scalar
from cardiolake.operators import series
from cardiolake.params import CHUNK, VariabilityParams, WindowParams


def variability_buckets(
    samples: DataFrame,
    params: VariabilityParams = VariabilityParams(),
    value: str = "fhr",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """One row per bucket ``bucket`` of ``n`` samples; ``window_value`` where a counted window starts."""
    samples = samples if "chunk" in samples.columns else series.with_chunk(samples, size)
    unit = series.common_step(params.step, params.window, size)
    buckets = series.step_buckets(samples, unit, value, keys, size)
    placed, frame = series.bucket_frames(buckets, unit, params.window, keys, size)
    starts = F.col("bucket") * unit % params.step == 0
    rows = F.sum("n").over(frame)
    valid = F.sum("n_valid").over(frame)
    spread = F.max("high").over(frame) - F.min("low").over(frame)
    # Fewer rows than a window behind bucket 0 means the whole record is shorter than a window.
    short = (F.col("bucket") == 0) & (rows < params.window) & (valid > 0)
    counted = (rows == params.window) & (valid >= params.window * params.min_valid_ratio)
    return (
        placed.withColumn("window_value", F.when(short | (starts & counted), spread))
        .where("core")
        .select(*keys, "bucket", "n", (F.col("bucket") * unit).alias("start_idx"), "window_value")
    )


def variability_windows(
    samples: DataFrame,
    params: VariabilityParams = VariabilityParams(),
    value: str = "fhr",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """One row per counted window: ``start_idx`` and ``window_value``.

    This is the long form of the window list; as an array it would grow with the series. The
    row with ``start_idx = NULL`` marks each bucket that starts no counted window.
    """
    return variability_buckets(samples, params, value, keys, size).select(
        *keys, F.when(F.col("window_value").isNotNull(), F.col("start_idx")).alias("start_idx"), "window_value"
    )


def variability_inside(
    samples: DataFrame,
    window: WindowParams = WindowParams(),
    params: VariabilityParams = VariabilityParams(),
    value: str = "fhr",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """``variability`` of every sliding window, keyed by ``(*keys, w)``; overlapping windows share the inner ones."""
    if window.step % params.step or window.window < params.window:
        raise ValueError(f"windows of {window.window} every {window.step} samples do not share windows of {params.window} every {params.step}")
    unit = series.common_step(params.step, params.window, size)
    inner = variability_buckets(samples, params, value, keys, size)
    placed, whole, frame = series.window_frames(inner, unit, window.window, window.step, keys, size)
    fitting = frame.rowsBetween(0, (window.window - params.window) // unit)
    figures = {"mean": F.avg, "low": F.min, "high": F.max, "n_windows": F.count}
    framed = placed.withColumns({name: f("window_value").over(fitting) for name, f in figures.items()}).where(whole)
    return variability_row(framed.select(*keys, "w", *figures), [*keys, "w"])


def variability(
    samples: DataFrame,
    params: VariabilityParams = VariabilityParams(),
    value: str = "fhr",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """Variability per record; the class uses the unrounded mean."""
    windows = variability_windows(samples, params, value, keys, size)
    summary = windows.groupBy(*keys).agg(
        F.avg("window_value").alias("mean"),
        F.min("window_value").alias("low"),
        F.max("window_value").alias("high"),
        F.count("window_value").alias("n_windows"),
    )
    return variability_row(summary, keys)


def variability_row(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The result row of ``mean``, ``low``, ``high`` and ``n_windows``."""
    known = F.col("n_windows") > 0
    category = F.when(known, scalar.variability_class(F.col("mean"))).otherwise("Unknown")

    def one_place(column: str):
        return F.when(known, scalar.half_even(F.col(column), 1)).otherwise(0.0)

    return summary.withColumn("category", category).select(
        *keys,
        one_place("mean").alias("value"),
        "category",
        (F.col("category") == "Moderate").alias("is_normal"),
        F.col("category").isin("Absent", "Minimal", "Unknown").alias("is_concerning"),
        one_place("low").alias("min_value"),
        one_place("high").alias("max_value"),
        "n_windows",
    )
