"""Decelerations: runs below the baseline, their type, severity signs and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardiolake.functions.scalar import half_even
from cardiolake.operators import series
from cardiolake.params import CHUNK, DecelParams

# Severity texts in reporting order.
SEVERE_DROP = "Severe drop (<70 bpm for >60s)"
ABSENT_INTERNAL = "Absent internal variability"
SLOW_RECOVERY = "Slow recovery (%.0fs)"
OVERSHOOT = "Overshoot"
W_SHAPE = "W-shape (biphasic)"

TYPES = ("Early", "Late", "Variable", "Prolonged", "Unclassified")


def below_baseline_runs(
    samples: DataFrame,
    baseline: DataFrame,
    params: DecelParams = DecelParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """Runs strictly below ``baseline - min_depth``; a missing sample ends a run.

    ``baseline`` has the keys and ``value``. Only below-threshold samples are grouped. Runs
    shorter than the minimum are dropped; there is no upper limit.
    """
    per_chunk = series.per_chunk(
        baseline.select(*keys, F.col("value").alias("baseline")), samples, keys
    )
    low = (
        samples.select(*keys, "chunk", "i", "fhr")
        .join(per_chunk, [*keys, "chunk"])
        .where(F.col("fhr") < F.col("baseline") - params.min_depth)
    )
    pieces = [
        series.Piece("_nadir", F.min(F.struct("fhr", "i")), "min"),
        series.Piece("_first", F.min(F.struct("i", "fhr")), "min"),
        series.Piece("_high", F.max("fhr"), "max"),
        series.Piece("_below_70", F.count_if(F.col("fhr") < 70), "sum"),
        series.Piece("baseline", F.max("baseline"), "max"),
    ]
    minimum = params.samples(params.min_duration_seconds)
    found = series.runs(low, pieces, keys, size).where(
        F.col("end_idx") - F.col("start_idx") >= minimum
    )
    return found.select(
        *keys,
        "start_idx",
        "end_idx",
        "baseline",
        F.col("_nadir.fhr").alias("nadir_bpm"),
        F.col("_nadir.i").alias("nadir_idx"),
        F.col("_first.fhr").alias("first_bpm"),
        F.col("_high").alias("high_bpm"),
        F.col("_below_70").alias("n_below_70"),
    )


def descent_rate(first: Column, nadir: Column, start: Column, at: Column) -> Column:
    return F.when(at > start, (first - nadir) / (at - start)).otherwise(0.0)


def decel_type(rate: Column, lag_seconds: Column, has_contraction: Column) -> Column:
    """Type ladder; the order of the tests matters."""
    return (
        F.when(rate > 0.5, "Variable")
        .when(~has_contraction, "Unclassified")
        .when(F.abs(lag_seconds) < 5, "Early")
        .when(lag_seconds > 15, "Late")
        .when(rate > 0.3, "Variable")
        .otherwise("Unclassified")
    )


def _near(
    found: DataFrame,
    samples: DataFrame,
    first: Column,
    end: Column,
    columns: Sequence[str],
    keys: Sequence[str],
    size: int,
) -> DataFrame:
    """Interval join of runs with the samples in ``[first, end)``.

    Runs are expanded to the chunks their interval touches and hashed per ``(record, chunk)``,
    the layout the samples already have.
    """
    spans = found.withColumns({"_from": F.greatest(first, F.lit(0).cast("long")), "_to": end})
    spans = spans.withColumn(
        "chunk", F.explode(F.expr(f"sequence(_from div {size}, (_to - 1) div {size})"))
    ).hint("shuffle_hash")
    near = samples.select(*keys, "chunk", "i", *columns).join(spans, [*keys, "chunk"])
    i = F.col("i")
    return near.where((i >= F.col("_from")) & (i < F.col("_to"))).drop("_from", "_to")


def with_context(
    found: DataFrame,
    samples: DataFrame,
    params: DecelParams = DecelParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """What surrounds each run: contraction peak, recovery and shape.

    A run always meets its own samples, so none is lost. Extremes and their position are taken
    in two passes: with plain numbers as state both aggregate by hash, and each chunk reduces
    its part to one row per run before anything moves.
    """
    before = params.samples(params.contraction_before_seconds)
    after = params.samples(params.contraction_after_seconds)
    recovery = params.samples(params.recovery_seconds)
    start, end, i = F.col("start_idx"), F.col("end_idx"), F.col("i")
    uc = F.coalesce("uc", F.lit(0.0))
    known = found.columns
    near = _near(
        found, samples, start - before, F.greatest(start + after, end + recovery), ("fhr", "uc"), keys, size
    ).withColumn("_mid", start + F.expr("(end_idx - start_idx) div 2"))
    mid = F.col("_mid")
    in_uc = i < start + after
    first_half = (i >= start) & (i < mid)
    second_half = (i >= mid) & (i < end)
    middle = F.when(mid - start > 5, (i >= mid - 5) & (i < mid + 5)).otherwise(
        (i >= start) & (i < start + 10)
    )
    context = near.groupBy(*known).agg(
        F.max(F.when(in_uc, uc)).alias("_uc_top"),
        F.count(F.when(in_uc, F.col("uc"))).alias("_uc_present"),
        F.count_if(in_uc & (F.col("uc").isNull() | (F.col("uc") != 0))).alias("_uc_not_zero"),
        F.max(F.when((i >= end) & (i < end + recovery), F.col("fhr"))).alias("_after_high"),
        F.min(F.when(first_half, F.col("fhr"))).alias("_first_low"),
        F.min(F.when(second_half, F.col("fhr"))).alias("_second_low"),
        F.max(F.when(middle & (i < end), F.col("fhr"))).alias("_middle_high"),
    )
    # Not an equality: that would become a join key and move every sample again.
    at_top = _near(context, samples, start - before, start + after, ("uc",), keys, size).where(
        uc >= F.col("_uc_top")
    )
    return at_top.groupBy(*context.columns).agg(F.min("i").alias("_uc_at"))


def decelerations(
    samples: DataFrame,
    baseline: DataFrame,
    params: DecelParams = DecelParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """One row per deceleration of ``samples(keys, i, fhr[, uc])``."""
    if "chunk" not in samples.columns:
        samples = series.with_chunk(samples, size)
    if "uc" not in samples.columns:
        samples = samples.withColumn("uc", F.lit(0.0))
    fs = F.lit(params.sampling_rate)
    found = below_baseline_runs(samples, baseline, params, keys, size)
    events = with_context(found, samples, params, keys, size)
    start, end = F.col("start_idx"), F.col("end_idx")
    nadir, at = F.col("nadir_bpm"), F.col("nadir_idx")
    base = F.col("baseline")
    contraction = (F.col("_uc_present") > 0) & (F.col("_uc_not_zero") > 0)
    events = events.withColumns(
        {
            "_rate": descent_rate(F.col("first_bpm"), nadir, start, at),
            "_contraction": contraction,
            "_lag": F.when(contraction, (at - F.col("_uc_at")) / fs).otherwise(0.0),
            "_duration": (end - start) / fs,
            "_recovery": (end - at) / fs,
        }
    )
    signs = F.array_compact(
        F.array(
            F.when(F.col("n_below_70") / fs > 60, SEVERE_DROP),
            F.when(F.col("high_bpm") - nadir < 5, ABSENT_INTERNAL),
            F.when(
                F.col("_recovery") > 60,
                F.format_string(SLOW_RECOVERY, half_even(F.col("_recovery"))),
            ),
            F.when(F.col("_after_high") > base + 10, OVERSHOOT),
            F.when(
                (end - start > 20)
                & (F.col("_first_low") < base - 10)
                & (F.col("_second_low") < base - 10)
                & (F.col("_middle_high") > F.col("_first_low") + 10),
                W_SHAPE,
            ),
        )
    )
    kind = F.when(F.col("_duration") > params.prolonged_seconds, "Prolonged").otherwise(
        decel_type(F.col("_rate"), F.col("_lag"), F.col("_contraction"))
    )
    return events.withColumn("severity_signs", signs).select(
        *keys,
        "start_idx",
        "end_idx",
        "nadir_idx",
        half_even(base - nadir, 1).alias("depth"),
        half_even(F.col("_duration"), 1).alias("duration_seconds"),
        kind.alias("decel_type"),
        half_even(F.col("_lag"), 1).alias("lag_seconds"),
        (F.size("severity_signs") > 0).alias("has_severity_signs"),
        "severity_signs",
        half_even(F.col("_rate"), 3).alias("descent_rate"),
        half_even(nadir, 1).alias("nadir_value"),
    )


def decel_counts(
    events: DataFrame, records: DataFrame, keys: Sequence[str] = series.KEYS
) -> DataFrame:
    """Counts per record and type; records without any deceleration keep zeros."""
    of = {t: F.col("decel_type") == t for t in TYPES}
    counted = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("decel_count"),
        *[F.count_if(of[t]).alias(f"{t.lower()}_count") for t in TYPES],
        F.count_if(of["Variable"] & F.col("has_severity_signs")).alias("severe_variable_count"),
    )
    figures = [c for c in counted.columns if c not in keys]
    return records.select(*keys).distinct().join(counted, list(keys), "left").na.fill(0, figures)


def recurrent_share(count: Column, contractions: Column, ratio: float = 0.5) -> Column:
    """At least ``ratio`` of the contractions come with a deceleration of one type."""
    return F.when(contractions > 0, count / contractions >= ratio).otherwise(False)


def recurrent_for_features(decels: Column, contractions: Column) -> Column:
    """More than half of the contractions come with a deceleration of any type."""
    return F.when(contractions > 0, decels / contractions > 0.5).otherwise(False)


def recurrent_count(count: Column) -> Column:
    """Three or more, as the safety rules read it."""
    return count >= 3
