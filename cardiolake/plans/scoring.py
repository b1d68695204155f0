"""Rules and scoring for every record of a samples table in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardiolake.operators import alerts, decide, series
from cardiolake.operators.baseline import baseline, baseline_inside
from cardiolake.operators.clean import clean
from cardiolake.operators.contractions import tachysystole
from cardiolake.operators.decelerations import decel_counts, decelerations
from cardiolake.operators.sinusoidal import result_row, sinusoidal
from cardiolake.operators.variability import variability, variability_inside
from cardiolake.operators.windows import window_samples
from cardiolake.params import (
    CHUNK,
    BaselineParams,
    CleanParams,
    DecelParams,
    SinusoidalParams,
    TachysystoleParams,
    VariabilityParams,
    WindowParams,
)
from cardiolake.operators.staging import stage

RULE_CONFIDENCE = 0.7
NO_WINDOW_CONFIDENCE = 0.5


@dataclass(frozen=True)
class RuleParams:
    clean: CleanParams = field(default_factory=CleanParams)
    baseline: BaselineParams = field(default_factory=BaselineParams)
    variability: VariabilityParams = field(default_factory=VariabilityParams)
    decel: DecelParams = field(default_factory=DecelParams)
    tachysystole: TachysystoleParams = field(default_factory=TachysystoleParams)
    sinusoidal: SinusoidalParams = field(default_factory=SinusoidalParams)
    # "same": contractions pass the heart-rate cleaning rules; "raw": they are used as recorded.
    uc_mode: str = "same"

    def __post_init__(self) -> None:
        if self.uc_mode not in ("same", "raw"):
            raise ValueError(f"unknown uc_mode {self.uc_mode!r}")


def clean_record_signals(
    samples: DataFrame, params: RuleParams = RuleParams(), size: int = CHUNK
) -> DataFrame:
    """``record_id, chunk, i, fhr, uc`` after cleaning."""
    columns = ("fhr", "uc") if params.uc_mode == "same" else ("fhr",)
    return clean(samples.select("record_id", "i", "fhr", "uc"), columns, params.clean, size=size).select(
        "record_id", "chunk", "i", "fhr", "uc"
    )


def rule_findings(
    cleaned: DataFrame,
    params: RuleParams = RuleParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """All five rules: one wide row per record. Joins here are between one-row-per-record tables."""
    base = baseline(cleaned, params.baseline, keys=keys, size=size)
    vary = variability(cleaned, params.variability, keys=keys, size=size)
    return _findings(cleaned, base, vary, params, keys, size)


def rule_findings_per_window(
    cleaned: DataFrame,
    window: WindowParams = WindowParams(),
    params: RuleParams = RuleParams(),
    size: int = CHUNK,
) -> DataFrame:
    """All five rules inside each sliding window: one wide row per ``(record_id, w)``.

    Baseline and variability come from windows that the overlapping ones share. Decelerations have
    a threshold of the window's own, and contractions its own quartile and deviation, so these two
    read the window's samples, gathered by ``(record_id, w)`` once. A window that is shorter than the
    sinusoidal rule asks for needs no spectrum.
    """
    keys = ("record_id", "w")
    base = stage(baseline_inside(cleaned, window, params.baseline, size=size), keys, keys)
    vary = variability_inside(cleaned, window, params.variability, size=size)
    inside = stage(window_samples(cleaned.select("record_id", "chunk", "i", "fhr", "uc"), window, size=size), keys, [*keys, "i"])
    bounds = base.select(*keys, F.col("window_start").alias("start_idx"), F.col("window_end").alias("end_idx"))
    waves = None
    if window.window < params.sinusoidal.window:
        short = bounds.select(
            *keys, (F.col("end_idx") - F.col("start_idx")).alias("n"), F.lit(0).alias("n_valid"),
            *[F.lit(None).cast("double").alias(c) for c in ("amplitude", "frequency", "dominance")],
        )
        waves = result_row(short, params.sinusoidal, keys)
    found = _findings(inside, base.drop("window_start", "window_end", "chunk"), vary, params, keys, size, waves)
    return bounds.join(found, list(keys))


def _findings(
    cleaned: DataFrame,
    base: DataFrame,
    vary: DataFrame,
    params: RuleParams,
    keys: Sequence[str],
    size: int,
    wave: DataFrame | None = None,
) -> DataFrame:
    events = decelerations(cleaned, base, params.decel, keys, size)
    counts = decel_counts(events, base, keys)
    contraction = tachysystole(cleaned, params.tachysystole, keys, size)
    if wave is None:
        wave = sinusoidal(cleaned, params.sinusoidal, keys=keys, size=size)
    on = list(keys)
    return (
        base.select(
            *keys,
            F.col("value").alias("baseline"),
            "is_normal",
            "is_bradycardia",
            "is_tachycardia",
            "stable_segment_found",
            F.col("confidence").alias("baseline_confidence"),
        )
        .join(
            vary.select(
                *keys,
                F.col("value").alias("variability_value"),
                F.col("category").alias("variability_category"),
                F.col("n_windows").alias("variability_windows"),
            ),
            on,
        )
        .join(counts, on)
        .join(
            contraction.select(
                *keys,
                F.col("detected").alias("tachysystole"),
                F.col("contractions_per_10min").alias("contraction_rate"),
                "total_contractions",
            ),
            on,
        )
        .join(
            wave.select(
                *keys,
                F.col("detected").alias("sinusoidal"),
                F.col("confidence").alias("sinusoidal_confidence"),
            ),
            on,
        )
    )


def decide_and_explain(findings: DataFrame) -> DataFrame:
    """Override and alert for rows with findings, ``ml_prediction`` and ``confidence``."""
    decided = decide.override(findings).withColumn("category", F.col("final_category") + 1)
    return alerts.with_alert(decided)


def score(
    samples: DataFrame,
    params: RuleParams = RuleParams(),
    votes: DataFrame | None = None,
    size: int = CHUNK,
    staged: bool = True,
) -> DataFrame:
    """One explained decision per record.

    ``votes`` (``record_id, ml_prediction, confidence``) come from a classifier; records it has no
    window for count as normal with confidence 0.5. Without votes the rule-only class is used.
    """
    cleaned = clean_record_signals(samples, params, size)
    if staged:
        cleaned = stage(cleaned)
    findings = rule_findings(cleaned, params, size=size)
    if votes is None:
        predicted = findings.withColumns(
            {"ml_prediction": decide.rule_class(), "confidence": F.lit(RULE_CONFIDENCE)}
        )
    else:
        predicted = findings.join(votes, "record_id", "left").withColumns(
            {
                "ml_prediction": F.coalesce(F.col("ml_prediction").cast("int"), F.lit(0)),
                "confidence": F.coalesce("confidence", F.lit(NO_WINDOW_CONFIDENCE)),
            }
        )
    return decide_and_explain(predicted)


def detail_card(scored: DataFrame) -> DataFrame:
    return scored.select(
        "record_id",
        F.format_string("%.0f bpm", "baseline").alias("baseline"),
        F.format_string("%.1f bpm", "variability_value").alias("variability"),
        F.upper("variability_category").alias("variability_category"),
        "late_count",
        "variable_count",
        "decel_count",
    )
