"""Cleaning of sampled signals: range rule, spike rule, short-gap fill, optional smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.operators import series
from cardiolake.params import CHUNK, CleanParams


def no_nan(column: str) -> Column:
    """Missing values are NULL from here on; NaN would compare greater than everything."""
    return F.nanvl(F.col(column), F.lit(None).cast("double"))


def in_range(column: Column, params: CleanParams = CleanParams()) -> Column:
    """The value where it is plausible (bounds included, zero never), else NULL."""
    return F.when(column.between(params.low, params.high) & (column != 0), column)


def is_spike(value: Column, previous: Column, params: CleanParams = CleanParams()) -> Column:
    """A jump from a present neighbour; both edges of a one-sample spike are marked."""
    return F.coalesce(F.abs(value - previous) > params.spike_threshold, F.lit(False))


def spikes(
    samples: DataFrame,
    column: str = "fhr",
    params: CleanParams = CleanParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """``spike`` flag on range-cleaned samples."""
    placed = series.with_halo(samples.withColumn("_r", in_range(no_nan(column), params)), 1, 0, size)
    flagged = placed.withColumn(
        "spike", is_spike(F.col("_r"), F.lag("_r").over(series.by_chunk(keys)), params)
    )
    return series.core_rows(flagged, size).drop("_r")


def clean(
    samples: DataFrame,
    columns: Sequence[str] = ("fhr",),
    params: CleanParams = CleanParams(),
    smoothing: bool = False,
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """Clean every listed column in one shuffle by ``(record, chunk)``.

    Adds ``<c>_raw, <c>_invalid, <c>_filled, <c>_unfilled`` and replaces ``<c>``; keeps ``chunk``.
    Gaps up to the limit are filled linearly between their neighbours, gaps at a series end by
    the one neighbour they have; longer gaps and all-missing series stay missing. The halo is
    longer than the gap limit, so a gap whose end is out of sight is known to be too long.
    """
    limit = params.max_gap_samples
    reach = params.smoothing_reach if smoothing else 0
    halo = limit + 4 + reach
    forward, backward = series.by_chunk(keys), series.by_chunk_backwards(keys)
    running = (Window.unboundedPreceding, 0)

    df = samples
    for c in columns:
        df = df.withColumn(f"{c}_raw", no_nan(c))
    df = series.with_halo(df, halo, halo, size)
    df = df.withColumns({f"_r_{c}": in_range(F.col(f"{c}_raw"), params) for c in columns})
    df = df.withColumns({f"_p_{c}": F.lag(f"_r_{c}").over(forward) for c in columns})
    df = df.withColumns(
        {
            f"_v_{c}": F.when(
                ~is_spike(F.col(f"_r_{c}"), F.col(f"_p_{c}"), params), F.col(f"_r_{c}")
            )
            for c in columns
        }
    )
    df = df.withColumns({f"_i_{c}": F.expr(f"if(_v_{c} is null, null, i)") for c in columns})
    ahead = {}
    behind = {"_end": F.first("i").over(backward.rowsBetween(*running))}
    for c in columns:
        for kind in ("v", "i"):
            src = f"_{kind}_{c}"
            ahead[f"_b{kind}_{c}"] = F.last(src, True).over(forward.rowsBetween(*running))
            behind[f"_a{kind}_{c}"] = F.last(src, True).over(backward.rowsBetween(*running))
    # Same order as the lag above first: the rows are sorted twice in all, not three times.
    df = df.withColumns(ahead).withColumns(behind)

    starts_here = F.col("chunk") == 0
    ends_here = F.col("_end") < (F.col("chunk") + 1) * size + halo - 1
    for c in columns:
        b, a, ib, ia = (F.col(f"_{k}_{c}") for k in ("bv", "av", "bi", "ai"))
        missing = F.col(f"_v_{c}").isNull()
        length = F.coalesce(ia, F.col("_end") + 1) - F.coalesce(ib, F.lit(-1)) - 1
        short = (
            missing
            & (length <= limit)
            & (ib.isNotNull() | ia.isNotNull())
            & (ib.isNotNull() | starts_here)
            & (ia.isNotNull() | ends_here)
        )
        linear = b + (a - b) / (ia - ib) * (F.col("i") - ib)
        fill = F.when(short, F.coalesce(linear, b, a))
        df = df.withColumns(
            {
                f"{c}_invalid": missing,
                f"{c}_filled": short,
                f"{c}_unfilled": missing & ~short,
                c: F.coalesce(F.col(f"_v_{c}"), fill),
            }
        )
    if reach:
        around = forward.rowsBetween(-reach, reach)
        df = df.withColumns({c: F.percentile(F.col(c), F.lit(0.5)).over(around) for c in columns})
    hidden = [n for n in df.columns if n.startswith("_")]
    return series.core_rows(df, size).drop(*hidden)


def gap_regions(
    samples: DataFrame,
    column: str,
    params: CleanParams = CleanParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """Missing runs ``[start_idx, end_idx)`` and whether the gap rule may fill them."""
    missing = series.with_chunk(samples, size).where(F.col(column).isNull())
    length = F.col("end_idx") - F.col("start_idx")
    return series.runs(missing.select(*keys, "chunk", "i"), (), keys, size).select(
        *keys,
        "start_idx",
        "end_idx",
        length.alias("n_samples"),
        (length <= params.max_gap_samples).alias("fillable"),
    )


def interpolate(
    samples: DataFrame,
    column: str,
    method: str = "linear",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """Replace every missing value, however long the gap; ends take the nearest value.

    ``nearest`` prefers the left neighbour on equal distance. Neighbours in other chunks come
    from one carried summary row per chunk.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown interpolation method {method!r}")
    point = F.when(F.col(column).isNotNull(), F.struct("i", F.col(column).alias("v")))
    df = series.with_chunk(samples, size).withColumn("_point", point)
    chunks = df.groupBy(*keys, "chunk").agg(
        F.min("_point").alias("_first"), F.max("_point").alias("_last")
    )
    chunks = series.carry(chunks, "_last", keys, True)
    chunks = series.carry(chunks, "_first", keys, False)
    running = (Window.unboundedPreceding, 0)
    df = (
        df.withColumn("_b", F.last("_point", True).over(series.by_chunk(keys).rowsBetween(*running)))
        .withColumn(
            "_a", F.last("_point", True).over(series.by_chunk_backwards(keys).rowsBetween(*running))
        )
        .join(chunks.drop("_first", "_last"), [*keys, "chunk"])
        .withColumn("_b", F.coalesce("_b", "_last_carried"))
        .withColumn("_a", F.coalesce("_a", "_first_carried"))
    )
    b, a, i = F.col("_b"), F.col("_a"), F.col("i")
    if method == "linear":
        between = (a.v - b.v) / (a.i - b.i) * (i - b.i) + b.v
    else:
        between = F.when(i - b.i <= a.i - i, b.v).otherwise(a.v)
    filled = F.coalesce(F.col(column), F.coalesce(between, b.v, a.v))
    return df.withColumns({f"{column}_was_missing": F.col(column).isNull(), column: filled}).drop(
        "_point", "_b", "_a", "_last_carried", "_first_carried"
    )


def clean_stats(
    cleaned: DataFrame,
    column: str = "fhr",
    params: CleanParams = CleanParams(),
    keys: Sequence[str] = series.KEYS,
) -> DataFrame:
    """Ten summary figures per record; population deviation, zeros when nothing is left."""
    n = F.count(F.lit(1))
    invalid = F.count_if(F.col(f"{column}_invalid"))
    filled = F.count_if(F.col(f"{column}_filled"))
    left = n - F.count(column)
    zero = F.lit(0.0)
    return cleaned.groupBy(*keys).agg(
        n.alias("total_samples"),
        (n / F.lit(params.sampling_rate)).alias("duration_seconds"),
        invalid.alias("invalid_samples"),
        (invalid / n * 100).alias("invalid_percent"),
        filled.alias("filled_samples"),
        (filled / n * 100).alias("filled_percent"),
        left.alias("remaining_missing"),
        (left / n * 100).alias("remaining_missing_percent"),
        F.coalesce(F.avg(column), zero).alias("mean_value"),
        F.coalesce(F.stddev_pop(column), zero).alias("std_value"),
    )
