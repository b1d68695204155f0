"""Encoders that fail or load models, and dataset builds that go on where they ended."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardiolake.operators import embedding
from cardiolake.operators.windows import prepare, windows
from cardiolake.params import WindowParams
from cardiolake.plans import dataset

WINDOW = WindowParams(window_minutes=1.0, step_minutes=0.25)
PARAMS = dataset.DatasetParams(window=WINDOW)


@pytest.fixture(scope="module")
def ready(spark, series_of):
    samples = series_of({name: {"fhr": [140 + (i * k) % 9 for i in range(500)]} for name, k in (("a", 1), ("b", 4))})
    return prepare(windows(samples, WINDOW), WINDOW).cache()


def test_one_failing_window_costs_one_row(ready):
    bad = {("a", 2), ("b", 0)}
    starts = {(r["record_id"], r["w"]): r["prepared"][:4] for r in ready.select("record_id", "w", F.slice("prepared", 1, 4).alias("prepared")).collect()}
    poison = [starts[k] for k in bad]

    def fragile(prepared, seeds):
        if any(np.allclose(row[:4], p) for row in prepared for p in poison):
            raise ArithmeticError("poisoned")
        return embedding.statistical_encoder(prepared, seeds)

    twins = {k for k, v in starts.items() if any(np.allclose(v, p) for p in poison)}
    whole = {(r["record_id"], r["w"]): r["embedding"] for r in embedding.embed(ready).collect()}
    for parts in (1, 5):
        rows = embedding.embed(ready.repartition(parts), fragile, isolate=True).collect()
        assert {(r["record_id"], r["w"]) for r in rows if r["error"]} == twins
        assert all(r["error"] == "ArithmeticError: poisoned" and r["embedding"] is None for r in rows if r["error"])
        assert all(r["embedding"] == whole[r["record_id"], r["w"]] for r in rows if not r["error"])
    with pytest.raises(Exception, match="poisoned"):
        embedding.embed(ready, fragile).collect()


def test_model_is_loaded_once_a_worker(spark, ready, tmp_path):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(240, embedding.DIMENSION))
    np.save(tmp_path / "weights.npy", weights)
    loads = tmp_path / "loads"
    loads.mkdir()

    def load(paths):
        import os
        import uuid

        import numpy as np

        (loads / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        held = np.load(paths[0])

        def model(prepared):
            assert len(prepared) <= 3
            return np.tanh(prepared @ held)

        return model

    encoder = embedding.ModelEncoder(spark, [str(tmp_path / "weights.npy")], load, batch_size=3)
    rows = embedding.embed(ready.repartition(12), encoder, is_mock=False).collect()
    rows += embedding.embed(ready.repartition(7), encoder, is_mock=False).collect()
    for r in rows:
        direct = np.tanh(np.array(r["prepared"], np.float32)[None, :] @ weights)[0]
        assert np.allclose(r["embedding"], direct, atol=1e-5) and not r["is_mock"]
    # One load for each worker process (Spark may replace some), though 19 partitions ran.
    names = [p.name.split("-")[0] for p in loads.iterdir()]
    assert len(names) == len(set(names)) < 19


@pytest.fixture(scope="module")
def recordings(series_of):
    return series_of({f"r{k}": {"fhr": [130 + (i * (k + 2)) % 11 for i in range(400)], "uc": [60.0] * 400} for k in range(4)}).cache()


def listed(spark, versions, labels=None):
    rows = [(k, v, (labels or {}).get(k, 1)) for k, v in versions.items()]
    return spark.createDataFrame(rows, "record_id string, version string, label int")


def test_updates_build_what_changed(spark, recordings, tmp_path):
    path = str(tmp_path / "set")
    first = {f"r{k}": "1" for k in range(3)}
    with pytest.raises(FileNotFoundError):
        dataset.read_updated(spark, listed(spark, first), path)
    assert dataset.update_dataset(spark, recordings, listed(spark, first), path, PARAMS) == 3
    whole = dataset.read_updated(spark, listed(spark, first), path).drop("features").orderBy("record_id", "w").collect()
    # Samples that fail when they are read: nothing has changed, so nobody reads them.
    broken = recordings.withColumn("fhr", F.raise_error(F.lit("read")).cast("double"))
    assert dataset.update_dataset(spark, broken, listed(spark, first), path, PARAMS) == 0
    # A new record, a new version and a new label are three builds; the rest is left alone.
    later = first | {"r1": "2", "r3": "1"}
    only = recordings.where("record_id in ('r1', 'r2', 'r3')").unionByName(broken.where("record_id = 'r0'"))
    assert dataset.update_dataset(spark, only, listed(spark, later, {"r2": 0}), path, PARAMS) == 3
    rows = dataset.read_updated(spark, listed(spark, later), path).drop("features").orderBy("record_id", "w").collect()
    assert [r for r in rows if r["record_id"] == "r0"] == [r for r in whole if r["record_id"] == "r0"]
    assert {(r["record_id"], r["label"]) for r in rows} == {("r0", 1), ("r1", 1), ("r2", 0), ("r3", 1)}
    assert len({(r["record_id"], r["w"]) for r in rows}) == len(rows) == 4 * len(whole) // 3
    # Other parameters change every record.
    other = dataset.DatasetParams(window=WindowParams(window_minutes=1.0, step_minutes=0.5))
    assert dataset.update_dataset(spark, recordings, listed(spark, later, {"r2": 0}), path, other) == 4


def test_a_build_that_was_cut_off_is_repeated(spark, recordings, tmp_path):
    path = str(tmp_path / "set")
    records = listed(spark, {"r0": "1", "r1": "1"})
    assert dataset.update_dataset(spark, recordings, records, path, PARAMS) == 2
    (marker,) = (tmp_path / "set" / "commits").glob("*/_SUCCESS")
    marker.unlink()
    with pytest.raises(FileNotFoundError):
        dataset.read_updated(spark, records, path)
    assert dataset.update_dataset(spark, recordings, records, path, PARAMS) == 2
    rows = dataset.read_updated(spark, records, path).select("record_id", "w").collect()
    assert len(rows) == len(set(rows)) > 0


def test_an_encoder_never_gets_a_whole_batch(spark):
    def few(prepared, seeds):
        if len(prepared) > 256:
            raise ArithmeticError(f"{len(prepared)} windows at once")
        return embedding.statistical_encoder(prepared, seeds)

    wave = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.sin(F.col("start_idx") + k).cast("float"))
    ready = spark.range(0, 700, 1, 1).select(F.lit("a").alias("record_id"), F.col("id").alias("start_idx")).withColumn("prepared", wave)
    at_once = embedding.embed(ready, few).collect()
    parted = embedding.embed(ready.repartition(9), few, isolate=True).orderBy("start_idx").collect()
    assert [r["start_idx"] for r in at_once] == list(range(700)) and not [r for r in parted if r["error"]]
    assert np.allclose([r["embedding"] for r in at_once], [r["embedding"] for r in parted], atol=1e-6)
    assert embedding.embed(ready.limit(0), few).collect() == []
