"""Sinusoidal pattern: one slow frequency that dominates the last twenty minutes."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardiolake.functions.scalar import half_even
from cardiolake.operators import series
from cardiolake.params import CHUNK, SinusoidalParams

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Segments that are transformed at a time.
_TOGETHER = 64


def confidence(dominance: Column, amplitude: Column, params: SinusoidalParams) -> Column:
    center = (params.min_amplitude + params.max_amplitude) / 2
    reach = (params.max_amplitude - params.min_amplitude) / 2
    dominance_score = F.least(F.lit(1.0), dominance / (params.dominance_threshold * 2))
    deviation = F.abs(amplitude - center) / reach if reach > 0 else F.lit(1.0)
    amplitude_score = F.greatest(F.lit(0.0), 1 - deviation)
    return F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), 0.6 * dominance_score + 0.4 * amplitude_score)
    )


def segment_figures(
    samples: DataFrame,
    params: SinusoidalParams = SinusoidalParams(),
    value: str = "fhr",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """(tail rows, gate figures per record); a tail has at most ``window`` rows."""
    if "chunk" not in samples.columns:
        samples = series.with_chunk(samples, size)
    last = series.tail(
        samples.select(*keys, "chunk", "i", F.col(value).alias("x")), params.window, keys, size
    )
    figures = last.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.count("x").alias("n_valid"),
        (F.max("x") - F.min("x")).alias("amplitude"),
    )
    return last, figures


def spectrum(segments: DataFrame, params: SinusoidalParams, keys: Sequence[str]) -> DataFrame:
    """Dominant in-band frequency and share of in-band magnitude of each row's ``values``.

    A discrete Fourier transform has no built-in expression. Segments are bounded arrays, transformed
    together in Arrow batches; no record is a Python group of its own.
    """
    step = 1.0 / params.sampling_rate
    low, high = params.min_cycles_per_minute / 60, params.max_cycles_per_minute / 60
    names = list(keys)

    def figures(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = np.nanmean(x, axis=1, keepdims=True)
        size = np.abs(np.fft.rfft(np.where(np.isnan(x), mean, x) - mean, axis=1))[:, 1 : (x.shape[1] + 1) // 2]
        frequency = np.arange(1, size.shape[1] + 1) * (1.0 / (x.shape[1] * step))
        band = (frequency >= low) & (frequency <= high)
        total, inside = size.sum(axis=1), size[:, band]
        dominant = frequency[band][inside.argmax(axis=1)] if band.any() else np.full(len(x), np.nan)
        return dominant, np.divide(inside.sum(axis=1), total, out=np.zeros(len(x)), where=total > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype(float), lists.offsets.to_numpy()
            lengths = np.diff(offsets)
            frequency, dominance = np.full(len(lengths), np.nan), np.zeros(len(lengths))
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                for at in range(0, len(rows), _TOGETHER):
                    some = rows[at : at + _TOGETHER]
                    frequency[some], dominance[some] = figures(flat[offsets[some][:, None] + np.arange(n)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(frequency, from_pandas=True), pa.array(dominance)],
                names=[*names, "frequency", "dominance"],
            )

    types = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)
    return segments.select(*keys, "values").mapInArrow(run, f"{key_schema}, frequency double, dominance double")


def sinusoidal(
    samples: DataFrame,
    params: SinusoidalParams = SinusoidalParams(),
    value: str = "fhr",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """One row per record; short or mostly missing segments never reach the transform."""
    last, figures = segment_figures(samples, params, value, keys, size)
    long_enough = F.col("n") >= params.window
    usable = long_enough & (F.col("n_valid") >= params.window * 0.5)
    chosen = last.select(*keys, "k", "x").join(figures.where(usable).select(*keys), list(keys))
    segments = chosen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"))
    segments = segments.withColumn("values", F.transform("s", lambda p: p.x))
    rows = figures.join(spectrum(segments, params, keys), list(keys), "left")
    return result_row(rows, params, keys)


def result_row(df: DataFrame, params: SinusoidalParams, keys: Sequence[str]) -> DataFrame:
    seen = F.col("frequency").isNotNull()
    fit = F.col("amplitude").between(params.min_amplitude, params.max_amplitude)
    minutes = F.lit(float(params.min_duration_minutes))
    return df.select(
        *keys,
        (seen & fit & (F.col("dominance") >= params.dominance_threshold)).alias("detected"),
        F.when(seen, half_even(confidence(F.col("dominance"), F.col("amplitude"), params), 2))
        .when((F.col("n") >= params.window) & (F.col("n_valid") < params.window * 0.5), 0.2)
        .otherwise(0.0)
        .alias("confidence"),
        half_even(F.col("frequency"), 4).alias("dominant_frequency"),
        half_even(F.col("frequency") * 60, 1).alias("frequency_cycles_per_min"),
        F.when(seen, half_even(F.col("amplitude"), 1)).otherwise(0.0).alias("amplitude"),
        (seen & fit).alias("amplitude_in_range"),
        F.when(seen, half_even(F.col("dominance"), 3)).otherwise(0.0).alias("dominance_ratio"),
        F.when(F.col("n") < params.window, F.col("n") / F.lit(params.sampling_rate) / 60)
        .when(seen, half_even(minutes, 1))
        .otherwise(minutes)
        .alias("analysis_duration_minutes"),
    )
