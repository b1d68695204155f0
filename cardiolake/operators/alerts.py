"""Explained alerts: headline, findings, recommendations and explanation per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.functions import scalar
from cardiolake.operators.staging import stage

# Texts shown to clinicians.
BASELINE_LOW_TEXT = "ברדיקרדיה - קצב בסיסי %.0f bpm"
BASELINE_HIGH_TEXT = "טכיקרדיה - קצב בסיסי %.0f bpm"
BASELINE_NORMAL_TEXT = "קצב בסיסי תקין: %.0f bpm"
VARIABILITY_TEXTS = {
    "ABSENT": "היעדר שונות (%.1f bpm) - ממצא חמור!",
    "MINIMAL": "שונות מזערית (%.1f bpm) - דורש מעקב",
    "MODERATE": "שונות תקינה (%.1f bpm)",
    "MARKED": "שונות מוגברת (%.1f bpm)",
}
VARIABILITY_OTHER_TEXT = "שונות: %.1f bpm (%s)"
LATE_TEXT = "זוהו %d האטות מאוחרות"
VARIABLE_TEXT = "זוהו %d האטות משתנות"
VARIABLE_SEVERE_TEXT = "זוהו %d האטות משתנות (%d עם סימני חומרה)"
PROLONGED_TEXT = "זוהו %d האטות ממושכות"
EARLY_TEXT = 'זוהו %d האטות מוקדמות (בד"כ שפירות)'
TACHYSYSTOLE_TEXT = "Tachysystole - %.1f צירים/10 דקות"
SINUSOIDAL_TEXT = "זוהתה תבנית סינוסואידלית - ממצא חמור!"
DECEL_WORDS = ("האטות", "האטה")
VARIABILITY_WORD = "שונות"
HEADLINES = {
    1: "סטטוס ירוק - קטגוריה 1 (תקין)",
    2: "התראה כתומה - קטגוריה 2 (ביניים)",
    3: "התראה אדומה - קטגוריה 3 (פתולוגי)",
}
RECOMMENDATIONS = {
    1: ("המשך ניטור שגרתי",),
    2: ("המשך ניטור צמוד", "שינוי תנוחת היולדת", "בדיקת לחץ דם והתייבשות"),
    3: (
        "הערכה מיידית של הסיבות האפשריות",
        "שקילת החייאה תוך-רחמית",
        "היערכות ליילוד מיידי אם אין שיפור",
    ),
}
EXPLAIN_1 = "כל הפרמטרים בטווח התקין."
EXPLAIN_2_BOTH = (
    "זוהו שינויים בדופק העובר הדורשים מעקב צמוד. השילוב של שינויים בשונות עם האטות מחייב "
    "ערנות מוגברת. יש להמשיך במעקב ולשקול התערבויות שמרניות."
)
EXPLAIN_2_DECELS = (
    "זוהו האטות בדופק העובר הדורשות מעקב. יש לעקוב אחר תדירות האירועים ומשך ההתאוששות."
)
EXPLAIN_2_VARIABILITY = "השונות אינה בטווח התקין. יש להמשיך לעקוב ולהעריך שינויים לאורך זמן."
EXPLAIN_2_OTHER = "ישנם ממצאים הדורשים מעקב צמוד. יש להמשיך לעקוב ולהעריך את ההתפתחות."
EXPLAIN_3_SINUSOIDAL = (
    "זוהתה תבנית סינוסואידלית - מצב זה מחייב הערכה דחופה. תבנית סינוסואידלית אמיתית קשורה "
    "לאנמיה עוברית חמורה או לאסון רפואי מתקרב. יש להתייעץ עם רופא בכיר באופן מיידי."
)
EXPLAIN_3_ABSENT = (
    "זוהה היעדר שונות בשילוב עם ממצאים מדאיגים נוספים. היעדר שונות מעיד על חוסר יכולת העובר "
    "להגיב לשינויים - מצב המעיד על מצוקה. נדרשת הערכה מיידית ושקילת התערבות."
)
EXPLAIN_3_OTHER = (
    "שילוב הממצאים מעיד על מצב פתולוגי הדורש התערבות מיידית. יש לבצע הערכה דחופה של מצב "
    "היולדת והעובר."
)
YES, NO = "כן", "לא"
OVERLAY_LATE = ("rgba(255, 0, 0, 0.3)", "האטה מאוחרת")
OVERLAY_VARIABLE = ("rgba(255, 165, 0, 0.3)", "האטה משתנה")
OVERLAY_PROLONGED = ("rgba(128, 0, 128, 0.3)", "האטה ממושכת")
OVERLAY_OTHER = ("rgba(100, 100, 100, 0.2)", "האטה")


def findings_list() -> Column:
    """Findings in reporting order, from the per-record findings row."""
    base, value = F.col("baseline"), F.col("variability_value")
    category = F.upper("variability_category")
    variability = F.format_string(VARIABILITY_OTHER_TEXT, value, F.col("variability_category"))
    for name, text in VARIABILITY_TEXTS.items():
        variability = F.when(category == name, F.format_string(text, value)).otherwise(variability)

    def counted(column: str, text: str) -> Column:
        return F.when(F.col(column) > 0, F.format_string(text, F.col(column)))

    severe = F.col("severe_variable_count")
    return F.array_compact(
        F.array(
            F.when(base < scalar.BASELINE_LOW, F.format_string(BASELINE_LOW_TEXT, base))
            .when(base > scalar.BASELINE_HIGH, F.format_string(BASELINE_HIGH_TEXT, base))
            .otherwise(F.format_string(BASELINE_NORMAL_TEXT, base)),
            variability,
            counted("late_count", LATE_TEXT),
            F.when(
                (F.col("variable_count") > 0) & (severe > 0),
                F.format_string(VARIABLE_SEVERE_TEXT, F.col("variable_count"), severe),
            ).otherwise(counted("variable_count", VARIABLE_TEXT)),
            counted("prolonged_count", PROLONGED_TEXT),
            counted("early_count", EARLY_TEXT),
            F.when(F.col("tachysystole"), F.format_string(TACHYSYSTOLE_TEXT, F.col("contraction_rate"))),
            F.when(F.col("sinusoidal"), SINUSOIDAL_TEXT),
        )
    )


def explanation(category: Column, findings: Column) -> Column:
    decels = F.exists(findings, lambda f: F.contains(f, F.lit(DECEL_WORDS[0])) | F.contains(f, F.lit(DECEL_WORDS[1])))
    variability = F.exists(findings, lambda f: F.contains(f, F.lit(VARIABILITY_WORD)))
    second = (
        F.when(decels & variability, EXPLAIN_2_BOTH)
        .when(decels, EXPLAIN_2_DECELS)
        .when(variability, EXPLAIN_2_VARIABILITY)
        .otherwise(EXPLAIN_2_OTHER)
    )
    third = (
        F.when(F.col("sinusoidal"), EXPLAIN_3_SINUSOIDAL)
        .when(F.upper("variability_category") == "ABSENT", EXPLAIN_3_ABSENT)
        .otherwise(EXPLAIN_3_OTHER)
    )
    return F.when(category == 3, third).when(category == 2, second).otherwise(EXPLAIN_1)


def with_alert(df: DataFrame, category: str = "category", confidence: str = "confidence") -> DataFrame:
    """Add the alert columns; a category outside 1-3 or confidence outside 0-1 fails the query."""
    c = F.col(category)
    advice = None
    for k, texts in RECOMMENDATIONS.items():
        texts = F.array(*[F.lit(t) for t in texts])
        advice = F.when(c == k, texts) if advice is None else advice.when(c == k, texts)
    headline = scalar.require(
        c.isin(1, 2, 3) & F.col(confidence).between(0, 1),
        scalar.lookup(c, HEADLINES),
        "alert needs a category of 1, 2 or 3 and a confidence from 0 to 1",
    )
    listed = df.withColumn("findings", findings_list())
    return listed.withColumns(
        {
            "headline": headline,
            "explanation": explanation(c, F.col("findings")),
            "recommendations": advice,
            "color": scalar.category_color(c),
            "emoji": scalar.category_emoji(c),
            "created_at": F.current_timestamp(),
        }
    )


def findings_summary() -> dict[str, Column]:
    """Traffic light and text per finding."""
    category = F.upper("variability_category")
    return {
        "baseline_color": F.when(F.col("baseline").between(110, 160), "green").otherwise("red"),
        "variability_color": F.when(category == "MODERATE", "green")
        .when(category.isin("MINIMAL", "MARKED"), "orange")
        .otherwise("red"),
        "late_color": F.when(F.col("late_count") > 0, "red").otherwise("green"),
        "variable_color": F.when(F.col("variable_count") > 0, "orange").otherwise("green"),
        "tachysystole_color": F.when(F.col("tachysystole"), "red").otherwise("green"),
        "baseline_text": F.format_string("%.0f bpm", F.col("baseline")),
        "variability_text": F.format_string("%.1f bpm", F.col("variability_value")),
        "late_text": F.col("late_count").cast("string"),
        "variable_text": F.col("variable_count").cast("string"),
        "tachysystole_text": F.when(F.col("tachysystole"), YES).otherwise(NO),
    }


def overlay(decels: DataFrame, sampling_rate: float = 4.0, labelled: int = 5) -> DataFrame:
    """Plot rows: minutes, fill colour by type and a label for the first few per record.

    The rank limit is applied before the shuffle, so each task sends at most ``labelled`` rows
    per record; the join back to all rows is by event. Events are read twice, so they are written
    once: nothing that finds them runs again.
    """
    decels = stage(decels, ["record_id"], ["record_id", "start_idx"])
    kind = F.col("decel_type")

    def by_type(part: int) -> Column:
        return (
            F.when(kind == "Late", OVERLAY_LATE[part])
            .when(kind == "Variable", OVERLAY_VARIABLE[part])
            .when(kind == "Prolonged", OVERLAY_PROLONGED[part])
            .otherwise(OVERLAY_OTHER[part])
        )

    event = ["record_id", "start_idx"]
    order = Window.partitionBy("record_id").orderBy("start_idx")
    first = (
        decels.select(*event)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= labelled)
    )
    per_minute = F.lit(sampling_rate * 60)
    start, end = F.col("start_idx") / per_minute, F.col("end_idx") / per_minute
    shown = F.col("_rank").isNotNull()
    return decels.join(first, event, "left").select(
        *event,
        start.alias("start_minute"),
        end.alias("end_minute"),
        by_type(0).alias("fill_color"),
        F.when(shown, by_type(1)).alias("label"),
        F.when(shown, (start + end) / 2).alias("label_minute"),
        F.when(shown, F.col("nadir_value")).alias("label_bpm"),
    )
