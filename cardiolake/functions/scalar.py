"""Column functions: classes, labels, rounding and category names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clinical limits.
PH_PATHOLOGICAL = 7.15
PH_INTERMEDIATE = 7.20
BASELINE_LOW = 110
BASELINE_HIGH = 160
VARIABILITY_ABSENT_MAX = 2.0
VARIABILITY_MINIMAL_MAX = 5.0
VARIABILITY_MODERATE_MAX = 25.0

# Names and colours by category.
CATEGORY_NAMES = {0: "Normal (Category 1)", 1: "Intermediate (Category 2)", 2: "Pathological (Category 3)"}
CATEGORY_COLORS = {1: "green", 2: "orange", 3: "red"}
CATEGORY_EMOJI = {1: "🟢", 2: "🟠", 3: "🔴"}
CATEGORY_HEX = {1: "#28a745", 2: "#fd7e14", 3: "#dc3545"}
CLASS_NAMES = {0: "Normal (Cat 1)", 1: "Intermediate (Cat 2)", 2: "Pathological (Cat 3)"}
VARIABILITY_ORDER = ("Absent", "Minimal", "Moderate", "Marked")


def lookup(key: Column, names: dict, default: str | None = None) -> Column:
    """Translate through a small fixed table."""
    out = None
    for k, v in names.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(F.lit(default))


def half_even(value: Column, digits: int = 0) -> Column:
    """Round the exact binary value, ties to even; NULL stays NULL.

    The scaled value is a double and its exact error (the value is split in halves whose products
    are exact), so 0.35, which is stored below 35 hundredths, gives 0.3 and 0.25 gives 0.2.
    """
    scale = F.lit(float(10**digits))
    x = value.cast("double")
    wide = x * F.lit(134217729.0)  # 2^27 + 1
    high = wide - (wide - x)
    scaled = x * scale
    error = (high * scale - scaled) + (x - high) * scale
    low = F.floor(scaled).cast("double")
    part = scaled - low
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (low % 2 != 0))))
    return (low + up.cast("double")) / scale


def nearest_5(value: Column) -> Column:
    return half_even(value / 5) * 5


def sample_time(idx: Column, sampling_rate: float = 4.0) -> Column:
    return idx / F.lit(sampling_rate)


def baseline_flags(value: Column) -> dict[str, Column]:
    return {
        "is_normal": value.between(BASELINE_LOW, BASELINE_HIGH),
        "is_bradycardia": value < BASELINE_LOW,
        "is_tachycardia": value > BASELINE_HIGH,
    }


def variability_class(value: Column) -> Column:
    return (
        F.when(value <= VARIABILITY_ABSENT_MAX, "Absent")
        .when(value <= VARIABILITY_MINIMAL_MAX, "Minimal")
        .when(value <= VARIABILITY_MODERATE_MAX, "Moderate")
        .otherwise("Marked")
    )


def outcome_label(ph: Column) -> Column:
    """0, 1 or 2; a missing or not-a-number pH counts as normal."""
    ph = F.nanvl(ph, F.lit(None).cast("double"))
    return F.when(ph < PH_PATHOLOGICAL, 2).when(ph < PH_INTERMEDIATE, 1).otherwise(0)


def category_name(prediction: Column) -> Column:
    return lookup(prediction, CATEGORY_NAMES, "Unknown")


def category_color(category: Column) -> Column:
    return lookup(category, CATEGORY_COLORS, "gray")


def category_emoji(category: Column) -> Column:
    return lookup(category, CATEGORY_EMOJI, "⚪")


def category_hex(category: Column) -> Column:
    return lookup(category, CATEGORY_HEX)


def one_hot(category: Column) -> dict[str, Column]:
    """Indicator per class; an unknown class has none."""
    return {
        f"is_{name.lower()}": F.coalesce(category == name, F.lit(False)).cast("double")
        for name in VARIABILITY_ORDER
    }


def require(condition: Column, value: Column, message: str) -> Column:
    """``value``, or a failing query where ``condition`` does not hold."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(
        F.raise_error(F.lit(message)).cast("string")
    )
