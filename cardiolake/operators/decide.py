"""Category decisions: rule-only class, safety overrides and the final category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardiolake.functions import scalar
from cardiolake.operators.decelerations import recurrent_count

# Explanations of the safety rules.
SINUSOIDAL_TEXT = (
    "Sinusoidal pattern detected. This is a critical finding indicating potential severe fetal "
    "anemia or compromise. Classification forced to Category 3 (Pathological) regardless of ML "
    "prediction."
)
ABSENT_TEXT_START = "Absent FHR variability with "
ABSENT_TEXT_END = (
    ". This combination is highly predictive of fetal acidemia. Classification forced to "
    "Category 3 (Pathological) regardless of ML prediction."
)
FLOOR_TEXT = (
    "Safety floor activated: ML predicted Normal (Category 1) but FHR variability is Absent. "
    "Absent variability requires closer monitoring. Classification upgraded to Category 2 "
    "(Intermediate)."
)
KEEP_TEXT = "No medical override triggered. Using ML prediction: Category "


def is_absent() -> Column:
    return F.lower(F.col("variability_category")) == "absent"


def rule_class() -> Column:
    """Class 0-2 from findings alone."""
    late = F.col("late_count") > 0
    return (
        F.when(F.col("sinusoidal"), 2)
        .when((F.col("variability_category") == "Absent") & (late | F.col("is_bradycardia")), 2)
        .when(F.col("variability_category").isin("Minimal", "Marked"), 1)
        .when(late, 1)
        .otherwise(0)
    )


def override(findings: DataFrame, prediction: str = "ml_prediction") -> DataFrame:
    """Add ``should_override, final_category, reason, explanation, category_name``.

    The first rule that holds decides; no rule ever lowers the prediction.
    """
    late = recurrent_count(F.col("late_count"))
    variable = recurrent_count(F.col("variable_count"))
    slow = F.coalesce(F.col("baseline") < scalar.BASELINE_LOW, F.lit(False))
    absent = is_absent()
    predicted = F.col(prediction)
    found = F.array_join(
        F.array_compact(
            F.array(
                F.when(late, "recurrent late decelerations"),
                F.when(variable, "recurrent variable decelerations"),
                F.when(slow, "bradycardia"),
            )
        ),
        " and ",
    )

    def ladder(sinus, combined, floor, keep) -> Column:
        return (
            F.when(F.col("sinusoidal"), sinus)
            .when(absent & (late | variable | slow), combined)
            .when(absent & (predicted == 0), floor)
            .otherwise(keep)
        )

    return findings.withColumns(
        {
            "should_override": ladder(True, True, True, F.lit(False)),
            "final_category": ladder(2, 2, 1, predicted),
            "reason": ladder(
                "SINUSOIDAL_PATTERN",
                "ABSENT_VARIABILITY_WITH_DECELS",
                "ABSENT_VARIABILITY_SAFETY_FLOOR",
                F.lit("NONE"),
            ),
            "override_explanation": ladder(
                SINUSOIDAL_TEXT,
                F.concat(F.lit(ABSENT_TEXT_START), found, F.lit(ABSENT_TEXT_END)),
                FLOOR_TEXT,
                F.concat(F.lit(KEEP_TEXT), (predicted + 1).cast("string"), F.lit(".")),
            ),
        }
    ).withColumn("category_name", scalar.category_name(F.col("final_category")))


def majority_vote(
    predictions: DataFrame, prediction: str = "prediction", order: str = "w", key: str = "record_id"
) -> DataFrame:
    """Most frequent class per record; on ties the class that occurs first."""
    counted = predictions.groupBy(key, prediction).agg(
        F.count(F.lit(1)).alias("_votes"), F.min(order).alias("_first")
    )
    best = F.max_by(prediction, F.struct("_votes", -F.col("_first")))
    return counted.groupBy(key).agg(best.alias("ml_prediction"))
