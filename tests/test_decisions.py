"""Overrides, alerts and reporting rows."""

import pytest
from pyspark.sql import functions as F

from cardiolake.operators import alerts, decide
from cardiolake.plans import scoring

COLUMNS = (
    "record_id string, baseline double, is_bradycardia boolean, variability_value double, "
    "variability_category string, late_count long, variable_count long, severe_variable_count long, "
    "prolonged_count long, early_count long, tachysystole boolean, contraction_rate double, "
    "sinusoidal boolean, ml_prediction int, confidence double"
)


def case(name, baseline=140.0, value=10.0, category="Moderate", late=0, variable=0, severe=0, prolonged=0,
         early=0, tachy=False, rate=3.0, sinus=False, ml=0, confidence=0.8):
    return (name, baseline, baseline < 110, value, category, late, variable, severe, prolonged, early, tachy, rate, sinus, ml, confidence)


def explained(spark, *cases):
    df = spark.createDataFrame(list(cases), COLUMNS)
    return {r["record_id"]: r for r in scoring.decide_and_explain(df).collect()}


def test_override_table(spark):
    got = explained(
        spark,
        case("sinus", sinus=True),
        case("absent_late", value=1.0, category="Absent", late=3),
        case("absent_brady", value=1.0, category="Absent", baseline=95.0),
        case("absent_all", value=1.0, category="Absent", late=3, variable=4, baseline=95.0),
        case("absent_two", value=1.0, category="Absent", late=2),
        case("absent_ml1", value=1.0, category="Absent", ml=1),
        case("plain", ml=1),
        case("normal"),
    )
    reason = {k: (r["final_category"], r["should_override"], r["reason"]) for k, r in got.items()}
    assert reason == {
        "sinus": (2, True, "SINUSOIDAL_PATTERN"),
        "absent_late": (2, True, "ABSENT_VARIABILITY_WITH_DECELS"),
        "absent_brady": (2, True, "ABSENT_VARIABILITY_WITH_DECELS"),
        "absent_all": (2, True, "ABSENT_VARIABILITY_WITH_DECELS"),
        "absent_two": (1, True, "ABSENT_VARIABILITY_SAFETY_FLOOR"),
        "absent_ml1": (1, False, "NONE"),
        "plain": (1, False, "NONE"),
        "normal": (0, False, "NONE"),
    }
    assert "recurrent late decelerations and recurrent variable decelerations and bradycardia." in got["absent_all"]["override_explanation"]
    assert got["plain"]["override_explanation"].endswith("Category 2.")
    assert got["sinus"]["category_name"] == "Pathological (Category 3)"
    assert all(r["final_category"] >= r["ml_prediction"] for r in got.values())


def test_alert_texts(spark):
    got = explained(
        spark,
        case("green"),
        case("brady", baseline=100.0, ml=1),
        case("tachy", baseline=175.0, ml=1, late=1, variable=2, severe=1, prolonged=1, early=2, tachy=True, rate=6.0),
        case("absent", value=1.0, category="Absent", late=3),
        case("sinus", sinus=True),
        case("other", ml=2),
        case("unknown", value=0.0, category="Unknown"),
    )
    assert got["green"]["headline"] == "סטטוס ירוק - קטגוריה 1 (תקין)"
    assert list(got["green"]["findings"]) == ["קצב בסיסי תקין: 140 bpm", "שונות תקינה (10.0 bpm)"]
    assert list(got["green"]["recommendations"]) == ["המשך ניטור שגרתי"]
    assert got["brady"]["findings"][0] == "ברדיקרדיה - קצב בסיסי 100 bpm"
    assert got["brady"]["explanation"] == alerts.EXPLAIN_2_VARIABILITY
    assert list(got["tachy"]["findings"])[0] == "טכיקרדיה - קצב בסיסי 175 bpm"
    assert list(got["tachy"]["findings"])[2:] == [
        "זוהו 1 האטות מאוחרות",
        "זוהו 2 האטות משתנות (1 עם סימני חומרה)",
        "זוהו 1 האטות ממושכות",
        'זוהו 2 האטות מוקדמות (בד"כ שפירות)',
        "Tachysystole - 6.0 צירים/10 דקות",
    ]
    assert got["tachy"]["explanation"] == alerts.EXPLAIN_2_BOTH
    assert got["absent"]["findings"][1] == "היעדר שונות (1.0 bpm) - ממצא חמור!"
    assert got["absent"]["explanation"] == alerts.EXPLAIN_3_ABSENT and len(got["absent"]["recommendations"]) == 3
    assert got["sinus"]["explanation"] == alerts.EXPLAIN_3_SINUSOIDAL and got["sinus"]["color"] == "red"
    assert got["other"]["explanation"] == alerts.EXPLAIN_3_OTHER
    assert got["unknown"]["findings"][1] == "שונות: 0.0 bpm (Unknown)"


def test_alert_guards(spark):
    df = spark.createDataFrame([case("x", confidence=1.5)], COLUMNS)
    with pytest.raises(Exception, match="confidence"):
        scoring.decide_and_explain(df).collect()
    df = spark.createDataFrame([case("x", ml=7)], COLUMNS)
    with pytest.raises(Exception, match="category"):
        scoring.decide_and_explain(df).collect()


def test_explanation_without_variability_text(spark):
    df = spark.createDataFrame([(2, ["האטה"], False, "x"), (2, ["z"], False, "x")], "c int, f array<string>, sinusoidal boolean, variability_category string")
    got = [r[0] for r in df.select(alerts.explanation(F.col("c"), F.col("f"))).collect()]
    assert got == [alerts.EXPLAIN_2_DECELS, alerts.EXPLAIN_2_OTHER]


def test_rule_class(spark):
    df = spark.createDataFrame(
        [
            case("a", sinus=True), case("b", category="Absent", late=1), case("c", category="Absent", baseline=100.0),
            case("d", category="Absent"), case("e", category="Minimal"), case("f", category="Marked"), case("g", late=1), case("h"),
        ],
        COLUMNS,
    )
    got = {r[0]: r[1] for r in df.select("record_id", decide.rule_class()).collect()}
    assert got == {"a": 2, "b": 2, "c": 2, "d": 0, "e": 1, "f": 1, "g": 1, "h": 0}


def test_vote_tie_takes_the_class_seen_first(spark):
    votes = [("a", 0, 2), ("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("b", 0, 0), ("b", 1, 1), ("b", 2, 1)]
    df = spark.createDataFrame(votes, "record_id string, w long, prediction int")
    assert dict(decide.majority_vote(df).collect()) == {"a": 2, "b": 1}


def test_overlay_labels_the_first_five(spark):
    events = [("r", 240 * k, 240 * k + 120, 100.0, t) for k, t in enumerate(["Late", "Variable", "Prolonged", "Early", "Late", "Late", "Variable"])]
    df = spark.createDataFrame(events, "record_id string, start_idx long, end_idx long, nadir_value double, decel_type string")
    got = sorted(alerts.overlay(df).collect(), key=lambda r: r["start_idx"])
    assert [r["label"] is not None for r in got] == [True] * 5 + [False] * 2
    assert got[1]["start_minute"] == 1.0 and got[1]["label_minute"] == 1.25
    assert got[3]["fill_color"] == "rgba(100, 100, 100, 0.2)"
