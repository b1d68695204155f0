"""A stream of samples gives the windows of the batch plan."""

import random

import numpy as np
import pytest
from brute import clean as loop_clean
from pyspark.sql import functions as F

from cardiolake.operators.clean import clean
from cardiolake.operators.windows import windows
from cardiolake.params import CleanParams, WindowParams
from cardiolake.streaming.windows import Series, clean_values, stream_windows

WINDOW = WindowParams(window_minutes=1.0, step_minutes=0.25)


def signal(seed, n):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        kind, k = r.random(), r.choice([1, 3, 39, 40, 41, 60])
        out += [None] * k if kind < 0.3 else [0.0] * k if kind < 0.4 else [r.choice([140.0, 150.0, 185.0, 300.0]) for _ in range(k)]
    return out[:n]


def test_cleaning_equals_the_loop():
    for seed in range(40):
        x = signal(seed, random.Random(seed).choice([1, 5, 40, 41, 200, 700]))
        got = clean_values(np.array([np.nan if v is None else v for v in x]), CleanParams())
        expected, _ = loop_clean(x)
        assert [None if np.isnan(v) else v for v in got] == pytest.approx(expected)


@pytest.mark.parametrize("step", (1, 17, 500))
def test_state_holds_a_window_and_no_more(step):
    """Fed piece by piece through saved states: the windows of one pass, and a bounded state."""
    x = np.array([np.nan if v is None else v for v in signal(3, 2000)])
    whole, series = clean_values(x, CleanParams()), Series(None)
    found = []
    for low in range(0, len(x), step):
        series.add(np.arange(low, min(low + step, len(x))), x[low : low + step])
        found += list(series.windows(CleanParams(), WINDOW, False))
        assert len(series.ready) <= WINDOW.window + 2 * 42 + WINDOW.step + step
        series = Series(series.state())
    series.close()
    found += list(series.windows(CleanParams(), WINDOW, True))
    assert [f[0] for f in found] == list(range((2000 - 240) // 60 + 1))
    for w, start, stop, n, _, values in found:
        part = whole[start:stop]
        assert n == (~np.isnan(part)).sum()
        assert [np.nan if v is None else v for v in values] == pytest.approx(part.tolist(), nan_ok=True)


def test_stream_of_files_equals_the_batch(spark, series_of, tmp_path):
    """Ten files, out of order inside and across neighbours, with repeated and lacking rows."""
    records = {f"r{k}": {"fhr": signal(k, n)} for k, n in enumerate((900, 241, 240, 239, 30))}
    samples = series_of(records).withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("i") / 4))
    rows = samples.collect()
    rng = random.Random(1)
    lacking = {("r0", 500), ("r1", 100)}
    parts = [[] for _ in range(10)]
    for r in rows:
        if (r["record_id"], r["i"]) not in lacking:
            at = min(9, max(0, r["i"] // 90 + rng.choice([0, 0, 0, 1])))
            parts[at].append(r)
            if rng.random() < 0.05:
                parts[min(9, at + 1)].append(r)
    for k, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, samples.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # The last file lies far ahead, so that the watermark ends every record.
    end = spark.createDataFrame([("end", 0, 140.0)], "record_id string, i long, fhr double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_100_000)))
    end.write.mode("append").parquet(str(tmp_path / "in"))
    query = (
        stream_windows(stream, WINDOW, delay_seconds=120)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = {(r["record_id"], r["w"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    known = samples.withColumn("fhr", F.when(~F.concat_ws("-", "record_id", "i").isin("r0-500", "r1-100"), F.col("fhr")))
    batch = windows(clean(known.select("record_id", "i", "fhr")), WINDOW).collect()
    assert set(got) == {(r["record_id"], r["w"]) for r in batch}
    for r in batch:
        g = got[r["record_id"], r["w"]]
        assert (g["start_idx"], g["end_idx"], g["n_present"]) == (r["start_idx"], r["end_idx"], r["n_present"])
        assert g["values"] == pytest.approx(r["values"])
        assert g["sum_present"] == pytest.approx(r["sum_present"])


@pytest.mark.parametrize("files,expected", [(5, 8), (123, 13)])
def test_triggers_do_not_grow_with_the_files(spark, tmp_path, files, expected):
    from cardiolake.plans.catalog import _files_a_trigger

    spark.range(0, files, 1, files).write.parquet(str(tmp_path / "in"))
    assert _files_a_trigger(spark, str(tmp_path / "in")) == expected
