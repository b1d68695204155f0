"""Signal utilities and quality figures per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardiolake.operators import clean as cleaning
from cardiolake.operators import series
from cardiolake.params import CHUNK, CleanParams


def signal_summary(
    samples: DataFrame,
    value: str,
    keys: Sequence[str] = series.KEYS,
    default: float = 0.0,
) -> DataFrame:
    """Valid ratio, safe mean and deviation, and quality, in one aggregate.

    Quality is the valid share times the share of valid samples within 50 to 250.
    """
    n, present = F.count(F.lit(1)), F.count(value)
    plausible = F.count_if(F.col(value).between(50, 250))
    d = F.lit(default)
    return samples.groupBy(*keys).agg(
        n.alias("n_samples"),
        (present / n).alias("valid_ratio"),
        F.coalesce(F.avg(value), d).alias("safe_mean"),
        F.when(present >= 2, F.stddev_pop(value)).otherwise(d).alias("safe_std"),
        F.when(present > 0, (present / n) * (plausible / present)).otherwise(0.0).alias("quality"),
    )


def safe_median(
    samples: DataFrame, value: str, keys: Sequence[str] = series.KEYS, default: float = 0.0
) -> DataFrame:
    found = series.percentiles(samples, value, 0.5, keys, name="safe_median")
    records = samples.select(*keys).distinct()
    return records.join(found, list(keys), "left").na.fill(default, ["safe_median"])


def profile(
    samples: DataFrame,
    params: CleanParams = CleanParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """Quality table per record for both signals.

    Missing share counts absent samples and, for the heart rate, zeros; figures over values use
    the non-zero heart rate and the present contraction signal. Artifacts are present heart-rate
    values outside the plausible range (zeros included); spikes are jumps after range cleaning.
    """
    flagged = cleaning.spikes(samples, "fhr", params, keys, size)
    f, u = F.col("fhr"), F.col("uc")
    live = F.when(f != 0, f)
    n = F.count(F.lit(1))
    base = flagged.withColumn("_live", live).groupBy(*keys).agg(
        (n / F.lit(params.sampling_rate * 60)).alias("duration_min"),
        ((n - F.count("_live")) / n * 100).alias("fhr_missing_pct"),
        F.avg("_live").alias("fhr_mean"),
        F.stddev_pop("_live").alias("fhr_std"),
        F.min("_live").alias("fhr_min"),
        F.max("_live").alias("fhr_max"),
        F.count_if(f == 0).alias("fhr_zeros"),
        F.count_if(~f.between(params.low, params.high)).alias("fhr_artifacts"),
        ((n - F.count(u)) / n * 100).alias("uc_missing_pct"),
        F.avg(u).alias("uc_mean"),
        F.stddev_pop(u).alias("uc_std"),
        F.min(u).alias("uc_min"),
        F.max(u).alias("uc_max"),
        F.count_if(u == 0).alias("uc_zeros"),
        F.count_if(u < 0).alias("uc_artifacts"),
        F.count_if("spike").alias("fhr_spikes"),
    )
    fhr_median = series.percentiles(
        samples.where("fhr <> 0").select(*keys, "fhr"), "fhr", 0.5, keys, name="fhr_median"
    )
    uc_median = series.percentiles(samples.select(*keys, "uc"), "uc", 0.5, keys, name="uc_median")
    return base.join(fhr_median, list(keys), "left").join(uc_median, list(keys), "left")


def fill_missing(
    samples: DataFrame,
    value: str,
    how: str = "zero",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """Replace missing values by zero or by the record's mean of present values."""
    if how == "zero":
        return samples.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
    if how != "mean":
        raise ValueError(f"unknown fill {how!r}")
    placed = samples if "chunk" in samples.columns else series.with_chunk(samples, size)
    means = placed.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    joined = placed.join(series.per_chunk(means, placed, keys), [*keys, "chunk"])
    return joined.withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def unprocessed(records: DataFrame, results: DataFrame, keys: Sequence[str] = series.KEYS) -> DataFrame:
    """Records without a result row, such as those that have no samples."""
    done = results.select(*keys).distinct()
    return records.select(*keys).distinct().join(done, list(keys), "left_anti")
