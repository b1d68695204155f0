"""Rounding, folds, class labels and peak spacing: exact results in bounded groups."""

import random

import pytest
from pyspark.sql import functions as F

from cardiolake.functions.scalar import half_even
from cardiolake.operators import metrics, series
from cardiolake.operators.contractions import spaced_long
from cardiolake.operators.spacing import chained, spaced_cells


@pytest.mark.parametrize(
    "value,digits",
    [(0.35, 1), (0.15, 1), (0.25, 1), (10.35, 1), (10.25, 1), (142.5, 0), (143.5, 0), (-0.25, 1), (-0.35, 1), (2.675, 2), (0.0005, 3), (1.0005, 3), (7.0, 2), (0.0, 1)],
)
def test_rounding_of_the_binary_value(spark, value, digits):
    got = spark.createDataFrame([(value,)], "x double").select(half_even(F.col("x"), digits)).first()[0]
    assert got == round(value, digits)


def test_rounding_agrees_with_python(spark):
    rows = spark.range(4000).select((F.col("id") * 0.05 - 50).alias("x"), (F.rand(3) * 300).alias("y"))
    for r in rows.select("x", "y", *[half_even(F.col(c), d).alias(f"{c}{d}") for c in "xy" for d in (0, 1, 2, 3)]).collect():
        assert all(r[f"{c}{d}"] == round(r[c], d) for c in "xy" for d in (0, 1, 2, 3))
    assert spark.sql("select cast(null as double) as x").select(half_even(F.col("x"), 1)).first()[0] is None


def test_grouped_folds_are_even_and_never_empty(spark):
    rows = spark.range(70).select((F.col("id") % 7).cast("string").alias("record_id"), F.col("id").alias("w"))
    folds = metrics.grouped_folds(rows, 5).groupBy("record_id").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in folds)
    assert sorted(sum(r["a"] == k for r in folds) for k in range(5)) == [1, 1, 1, 2, 2]
    with pytest.raises(ValueError, match="8 folds"):
        metrics.grouped_folds(rows, 8)


def test_no_shuffle_of_rows_by_class(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 3).cast("int").alias("label")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    for out in (metrics.with_weights(rows), metrics.contiguous_labels(rows)):
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Join" not in text
    weights = {(r["label"], round(r["weight"], 6)) for r in metrics.with_weights(rows).collect()}
    assert weights == {(0, round(1000 / (3 * 334), 6)), (1, round(1000 / (3 * 333), 6)), (2, round(1000 / (3 * 333), 6))}


def test_runs_of_one_record_do_not_share_a_group(spark):
    """Runs that touch no border stand alone; long runs are still joined over every border."""
    n = 1000
    flagged = spark.range(n).where("id % 3 < 2 and not (id >= 400 and id < 430) or (id >= 405 and id < 700)")
    rows = flagged.select(F.lit("a").alias("record_id"), F.col("id").alias("i"), F.expr("id div 10").alias("chunk"))
    found = series.runs(rows, size=10)
    kept = {r["id"] for r in flagged.collect()}
    expected, start = [], None
    for i in range(n + 1):
        if i in kept and start is None:
            start = i
        elif i not in kept and start is not None:
            expected.append((start, i))
            start = None
    assert sorted((r["start_idx"], r["end_idx"]) for r in found.collect()) == expected
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "ELSE start_idx" in plan


def test_staged_tables_go_with_their_scope(spark):
    from cardiolake.operators.staging import scope, stage

    rows = spark.range(10).select(F.lit("a").alias("record_id"), F.lit(0).alias("chunk"), F.col("id").alias("i"))
    with scope():
        kept = stage(rows, buckets=3)
        path = kept.inputFiles()[0]
        name = kept._jdf.queryExecution().analyzed().toString()
        assert kept.count() == 10 and "staged_" in name
    import os

    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
    assert not [t for t in spark.catalog.listTables() if t.name in name]


def test_header_parsing_moves_no_rows(spark):
    from cardiolake.sources import headers

    rows = spark.createDataFrame([("1", "1 1 4 10\n1.dat 16 100(0)/bpm 12 0 0 0 0 FHR\n#pH 7.1")], "record_id string, content string")
    assert "Exchange" not in headers.parse_headers(rows)._jdf.queryExecution().executedPlan().toString()


def test_nearest_higher_extent():
    import numpy as np

    from cardiolake.operators.contractions import nearest_higher

    rng = np.random.default_rng(3)
    for m in (1, 2, 3, 17, 64):
        chunks = np.sort(rng.choice(200, m, replace=False))
        highs = rng.integers(0, 9, m).astype(float)
        lows = highs - rng.integers(0, 9, m)
        home, height = rng.integers(-2, 203, 300), rng.integers(-1, 10, 300).astype(float)
        stop, base = nearest_higher(chunks, lows, highs, home, height)
        for k in range(300):
            before = [j for j in range(m) if chunks[j] < home[k]]
            want = next((j for j in reversed(before) if highs[j] > height[k]), -1)
            assert stop[k] == want and base[k] == min([lows[j] for j in before if j > want], default=np.inf)


def slow_spacing(peaks, distance):
    """Highest first, latest first among equals."""
    kept = []
    for h, p in sorted(((h, p) for p, h in peaks), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


def peak_trains():
    """Level, rising, falling, interleaved and random heights: chains of decisions in either direction."""
    rng = random.Random(2)
    n = 400
    heights = [
        [5.0] * n,
        [float(k) for k in range(n)],
        [float(-k) for k in range(n)],
        [float(k if k % 2 else n - k) for k in range(n)],
        [float(abs(k - n // 2)) for k in range(n)],
        [float(min(k % 150, 40)) for k in range(n)],
    ]
    heights += [[float(rng.randrange(m)) for _ in range(n)] for m in (2, 4, 1000)]
    for h in heights:
        places = sorted(rng.sample(range(n * 7), n)) if rng.random() < 0.5 else [k * 7 + rng.randrange(5) for k in range(n)]
        yield list(zip(places, h))


@pytest.mark.parametrize("size", (10, 100, 100_000))
def test_spacing_goes_over_cells(spark, size):
    """Small cells, whose decisions come from far away, give the result of one loop over all peaks."""
    trains = {f"t{k}": peaks for k, peaks in enumerate(peak_trains())}
    rows = [(name, p, h) for name, peaks in trains.items() for p, h in peaks]
    df = spark.createDataFrame(rows, "record_id string, p long, h double").cache()
    for found in (spaced_cells(df, 40, size=size), spaced_long(df, 40, size=max(size, 50))):
        got = {}
        for r in found.collect():
            got.setdefault(r["record_id"], []).append(r["p"])
        for name, peaks in trains.items():
            assert sorted(got[name]) == slow_spacing(peaks, 40), name


def test_chains_with_holes():
    """Cells without open peaks part a record into chains of their own."""
    cells = [(0, [(-1, 3, 8, [-1])]), (2, [(30, -1, 29, [-1]), (-1, 20, 25, [-1])]), (3, [(-1, -1, 31, [25])])]
    assert sorted(chained(cells)) == [(0, -1, -1), (2, -1, -1), (3, 25, -1)]
