"""Fused feature rows: a window embedding followed by eleven rule features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardiolake.functions import scalar
from cardiolake.operators import series
from cardiolake.operators.decelerations import recurrent_for_features
from cardiolake.operators.embedding import DIMENSION

# Names and order of the rule features.
RULE_FEATURES = (
    "baseline_norm",
    "variability_value_norm",
    "var_cat_absent",
    "var_cat_minimal",
    "var_cat_moderate",
    "var_cat_marked",
    "late_decel_count_norm",
    "variable_decel_count_norm",
    "recurrent_decels_flag",
    "tachysystole_flag",
    "sinusoidal_flag",
)
FEATURE_COUNT = DIMENSION + len(RULE_FEATURES)


def feature_names() -> list[str]:
    return [f"moment_emb_{i:04d}" for i in range(DIMENSION)] + list(RULE_FEATURES)


def feature_name_rows(positions: DataFrame) -> DataFrame:
    """``position -> name`` for rows that hold a 0-based ``position``."""
    p = F.col("position")
    rules = F.element_at(F.array(*[F.lit(n) for n in RULE_FEATURES]), (p - DIMENSION + 1).cast("int"))
    return positions.withColumn(
        "name", F.when(p < DIMENSION, F.format_string("moment_emb_%04d", p)).otherwise(rules)
    )


def rule_features(contractions: Column | None = None, loose: bool = False) -> dict[str, Column]:
    """Rule features of a row with the per-record findings.

    Expects ``baseline, variability_value, variability_category, late_count, variable_count,
    decel_count, tachysystole, sinusoidal``. Without a contraction count the recurrence flag is 0.
    ``loose`` accepts rows without a variability (see ``default_variability``).
    """
    value = F.col("variability_value")
    flags = scalar.one_hot(F.col("variability_category"))
    recurrent = recurrent_for_features(
        F.col("decel_count"), F.lit(0) if contractions is None else contractions
    )
    columns = [
        F.col("baseline") / 160.0,
        (default_variability(value) if loose else value) / 25.0,
        *flags.values(),
        F.col("late_count") / 10.0,
        F.col("variable_count") / 10.0,
        recurrent.cast("double"),
        F.col("tachysystole").cast("double"),
        F.col("sinusoidal").cast("double"),
    ]
    return dict(zip(RULE_FEATURES, columns))


def default_variability(value: Column) -> Column:
    """Loose inputs: a missing or zero value counts as 10."""
    return F.when(value.isNull() | (value == 0), 10.0).otherwise(value)


def with_findings(
    windows: DataFrame, findings: DataFrame, keys: Sequence[str] = series.KEYS
) -> DataFrame:
    """Findings for every window; windows of records without findings are dropped.

    ``findings`` has one row per ``(record, chunk)`` when ``chunk`` is present there (see
    ``series.per_chunk``): the join then runs where the windows are built and a long record
    stays split. Join before encoding: the encoder stage does not keep the layout.
    """
    on = [*keys, "chunk"] if "chunk" in findings.columns else list(keys)
    return windows.join(findings, on)


def fuse(embedded: DataFrame, contractions: Column | None = None, loose: bool = False) -> DataFrame:
    """Add ``features array<float>[1035]`` to embedded windows with findings; NULL where the embedding is."""
    named = rule_features(contractions, loose)
    vector = F.concat("embedding", F.array(*[c.cast("float") for c in named.values()]))
    checked = F.when(F.col("embedding").isNull() | (F.size(vector) == FEATURE_COUNT), vector).otherwise(
        F.raise_error(F.lit(f"feature vector must be {FEATURE_COUNT}-dimensional")).cast("array<float>")
    )
    return embedded.withColumn("features", checked)


def rule_part(features: Column) -> Column:
    return F.slice(features, DIMENSION + 1, len(RULE_FEATURES))


def embedding_part(features: Column) -> Column:
    return F.slice(features, 1, DIMENSION)
