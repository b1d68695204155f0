"""Rules on constructed signals with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from cardiolake.functions import scalar
from cardiolake.operators.baseline import baseline
from cardiolake.operators.clean import clean, clean_stats
from cardiolake.operators.contractions import contraction_count, tachysystole
from cardiolake.operators.decelerations import decel_counts, decelerations
from cardiolake.operators.sinusoidal import sinusoidal
from cardiolake.operators.variability import variability
from cardiolake.params import CleanParams


def rows(df):
    return {r["record_id"]: r.asDict() for r in df.collect()}


def test_gap_literals(series_of):
    df = clean(
        series_of(
            {
                "five_s": {"fhr": [140] * 50 + [None] * 20 + [140] * 50},
                "fifteen_s": {"fhr": [140] * 50 + [None] * 60 + [140] * 50},
                "ten_s": {"fhr": [130] * 50 + [None] * 40 + [150] * 50},
                "eleven_s": {"fhr": [140] * 50 + [None] * 44 + [140] * 50},
                "linear": {"fhr": [100] + [None] * 10 + [200]},
                "lead": {"fhr": [None] * 5 + [140] * 50},
                "trail": {"fhr": [140] * 50 + [None] * 5},
                "zeros": {"fhr": [140] * 10 + [0] * 3 + [140] * 10},
            }
        )
    )
    got = rows(
        df.groupBy("record_id").agg(
            F.count_if(F.col("fhr").isNull()).alias("left"),
            F.count_if("fhr_filled").alias("filled"),
            F.sort_array(F.collect_list("fhr")).alias("values"),
        )
    )
    assert (got["five_s"]["left"], got["five_s"]["filled"]) == (0, 20)
    assert set(got["five_s"]["values"]) == {140.0}
    assert (got["fifteen_s"]["left"], got["fifteen_s"]["filled"]) == (60, 0)
    assert (got["ten_s"]["left"], got["ten_s"]["filled"]) == (0, 40)
    assert (got["eleven_s"]["left"], got["eleven_s"]["filled"]) == (44, 0)
    assert got["linear"]["values"] == pytest.approx([100 + 100 * k / 11 for k in range(12)])
    assert got["lead"]["left"] == got["trail"]["left"] == got["zeros"]["left"] == 0


def test_clean_statistics(series_of):
    got = rows(clean_stats(clean(series_of({"a": {"fhr": [140] * 45 + [None] * 10 + [140] * 45}, "b": {"fhr": [0.0] * 8}}))))
    a = got["a"]
    assert (a["total_samples"], a["duration_seconds"], a["invalid_samples"], a["invalid_percent"]) == (100, 25.0, 10, 10.0)
    assert (a["filled_samples"], a["remaining_missing"], a["mean_value"], a["std_value"]) == (10, 0, 140.0, 0.0)
    assert (got["b"]["mean_value"], got["b"]["std_value"], got["b"]["remaining_missing"]) == (0.0, 0.0, 8)


def test_clean_params_are_checked():
    for bad in ({"sampling_rate": 0}, {"low": 240.0, "high": 50.0}, {"max_gap_seconds": -1}):
        with pytest.raises(ValueError):
            CleanParams(**bad)


def test_baseline_literals(series_of):
    flat = {str(v): {"fhr": [v] * 2400} for v in (140, 100, 170, 110, 160)}
    flat["short"] = {"fhr": [138] * 100}
    flat["none"] = {"fhr": [None] * 600}
    flat["wild"] = {"fhr": [120 + 30 * (i % 2) for i in range(600)]}
    got = rows(baseline(series_of(flat)))
    assert got["140"]["value"] == 140 and got["140"]["is_normal"] and got["140"]["confidence"] == 1.0
    assert got["100"]["is_bradycardia"] and got["170"]["is_tachycardia"]
    assert got["110"]["is_normal"] and got["160"]["is_normal"]
    assert got["short"]["value"] == 140 and got["short"]["confidence"] == 0.5
    assert (got["none"]["value"], got["none"]["confidence"], got["none"]["is_normal"]) == (140, 0.0, True)
    assert got["wild"]["value"] == 135 and not got["wild"]["stable_segment_found"]
    assert got["wild"]["segment_variability"] == 30


def test_half_even_to_five(spark):
    values = spark.createDataFrame([(142.5,), (137.5,), (142.6,), (147.5,)], "v double")
    got = [r[0] for r in values.select(scalar.nearest_5(F.col("v"))).collect()]
    assert got == [140.0, 140.0, 145.0, 150.0]


def test_variability_classes(spark, series_of):
    values = spark.createDataFrame([(v,) for v in (2.0, 2.1, 5.0, 5.1, 25.0, 25.1)], "v double")
    got = [r[0] for r in values.select(scalar.variability_class(F.col("v"))).collect()]
    assert got == ["Absent", "Minimal", "Minimal", "Moderate", "Moderate", "Marked"]
    made = rows(
        variability(
            series_of(
                {
                    "flat": {"fhr": [140] * 1200},
                    "wave": {"fhr": [140 + 5 * (i % 3) for i in range(1200)]},
                    "short": {"fhr": [140, 143] * 20},
                    "none": {"fhr": [None] * 700},
                }
            )
        )
    )
    assert (made["flat"]["category"], made["flat"]["value"], made["flat"]["n_windows"]) == ("Absent", 0.0, 9)
    assert (made["wave"]["category"], made["wave"]["is_normal"]) == ("Moderate", True)
    assert (made["short"]["category"], made["short"]["n_windows"], made["short"]["value"]) == ("Minimal", 1, 3.0)
    assert (made["none"]["category"], made["none"]["is_concerning"], made["none"]["n_windows"]) == ("Unknown", True, 0)


def triangle(n, start, top, end, height):
    out = [0.0] * n
    for i in range(start, end):
        out[i] = height * ((i - start) / (top - start) if i <= top else (end - i) / (end - top))
    return out


def test_deceleration_literals(spark, series_of):
    n = 1200
    dip = triangle(n, 300, 360, 440, 30)
    records = {
        "late": {"fhr": [140 - d for d in dip], "uc": triangle(n, 200, 280, 360, 50)},
        "deep": {"fhr": [140] * 500 + [115] * 120 + [140] * 580, "uc": [0] * n},
        "short": {"fhr": [140] * 500 + [120] * 40 + [140] * 660, "uc": [0] * n},
        "shallow": {"fhr": [140] * 500 + [130] * 120 + [140] * 580, "uc": [0] * n},
        "early": {"fhr": [140 - d for d in dip], "uc": triangle(n, 280, 360, 440, 50)},
    }
    base = spark.createDataFrame([(k, 140.0) for k in records], "record_id string, value double")
    samples = series_of(records)
    events = decelerations(samples, base).collect()
    by = {}
    for e in events:
        by.setdefault(e["record_id"], []).append(e)
    assert {k: len(v) for k, v in by.items()} == {"late": 1, "deep": 1, "early": 1}
    assert by["late"][0]["decel_type"] == "Late" and by["late"][0]["lag_seconds"] == 20.0
    assert by["early"][0]["decel_type"] == "Early"
    deep = by["deep"][0]
    assert (deep["depth"], deep["duration_seconds"], deep["decel_type"]) == (25.0, 30.0, "Unclassified")
    assert deep["severity_signs"] == ["Absent internal variability"]
    counts = rows(decel_counts(decelerations(samples, base), base))
    assert counts["short"]["decel_count"] == 0 and counts["late"]["late_count"] == 1


def contraction_train(n, every, height):
    return [max(0.0, height - abs(i % every - every / 2)) for i in range(n)]


def test_tachysystole_literals(series_of):
    records = {
        "many": {"uc": contraction_train(7200, 400, 80)},
        "few": {"uc": contraction_train(7200, 600, 80)},
        "zero": {"uc": [0.0] * 7200},
        "longer": {"uc": [0.0] * 4000 + contraction_train(7200, 400, 80)},
    }
    got = rows(tachysystole(series_of(records)))
    assert got["many"]["detected"] and got["many"]["total_contractions"] == 18
    assert got["many"]["contractions_per_10min"] == 6.0
    assert not got["few"]["detected"] and got["few"]["contractions_per_10min"] == 4.0
    assert (got["zero"]["contractions_per_10min"], got["zero"]["confidence"]) == (0.0, 0.0)
    assert got["longer"]["contraction_indices"] == got["many"]["contraction_indices"]
    whole = rows(contraction_count(series_of(records)))
    assert (whole["many"]["total_contractions"], whole["zero"]["total_contractions"]) == (18, 0)


def test_sinusoidal_literals(series_of):
    def wave(amplitude, minutes=25):
        return [140 + amplitude * math.sin(2 * math.pi * 4 / 60 * i / 4) for i in range(minutes * 240)]

    records = {
        "sine": {"fhr": wave(5)},
        "flat": {"fhr": [140.0] * 6000},
        "huge": {"fhr": wave(30)},
        "short": {"fhr": wave(5, 10)},
        "lost": {"fhr": [140.0] * 2000 + [None] * 4000},
    }
    got = rows(sinusoidal(series_of(records)))
    sine = got["sine"]
    assert sine["detected"] and sine["frequency_cycles_per_min"] == 4.0 and sine["amplitude"] == 10.0
    assert sine["dominance_ratio"] > 0.9 and sine["confidence"] == 1.0
    assert not got["flat"]["detected"] and not got["flat"]["amplitude_in_range"]
    assert not got["huge"]["detected"] and not got["huge"]["amplitude_in_range"] and got["huge"]["amplitude"] == 60.0
    assert got["short"]["dominant_frequency"] is None and got["short"]["analysis_duration_minutes"] == 10.0
    assert got["lost"]["confidence"] == 0.2 and not got["lost"]["detected"]


def test_outcome_labels(spark):
    values = [7.10, 7.14, 7.15, 7.17, 7.19, 7.20, 7.25, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "ph double")
    assert [r[0] for r in df.select(scalar.outcome_label(F.col("ph"))).collect()] == [2, 2, 1, 1, 1, 0, 0, 0, 0]
