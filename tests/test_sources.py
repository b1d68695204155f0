"""Header and signal files, tables and model files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardiolake.functions import scalar
from cardiolake.operators import embedding, features, metrics, model
from cardiolake.operators.windows import prepare, window_bounds, windows, windows_from_length
from cardiolake.params import WindowParams
from cardiolake.plans import dataset, scoring, training
from cardiolake.sources import headers, signals

HEADER = """{id} 2 4 {n}
{id}.dat 16 100(0)/bpm 12 0 15050 20101 0 FHR
{id}.dat 16 100/nd 12 0 700 378 0 UC

#----- Additional parameters for record {id}

#-- Outcome measures
#pH           {ph}
#BDecf        8.14
#Apgar1       6
#Gest. weeks  37
#Weight(g)    2660
#Hypertension 0
#Pos. II.st.  14400
#Sig2Birth    0
"""


@pytest.fixture(scope="module")
def recording_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("recordings")
    for name, n, ph in (("1001", 2000, "7.14"), ("1002", 700, "7.19"), ("1003", 300, "n/a")):
        (folder / f"{name}.hea").write_text(HEADER.format(id=name, n=n, ph=ph))
        k = np.arange(n)
        fhr = np.where(k % 50 == 3, -32768, 14000 + (k % 40) * 25)
        uc = (k % 400) * 10
        np.stack([fhr, uc], axis=1).astype("<i2").tofile(folder / f"{name}.dat")
    (folder / "1004.hea").write_text("not a header\n")
    (folder / "1005.hea").write_text("1005 1 4 10\n1005.dat 16 100/nd 12 0 0 0 0 UC\n")
    return str(folder)


def test_headers(spark, recording_folder):
    found = headers.read_headers(spark, recording_folder)
    assert [r[0] for r in headers.list_records(found).collect()] == ["1001", "1002", "1003", "1004", "1005"]
    assert sorted(r[0] for r in headers.first_records(found, 2).select("record_id").collect()) == ["1001", "1002"]
    assert headers.first_records(found, 0).count() == 5
    parsed = headers.parse_headers(found)
    errors = {r["record_id"]: r["error"] for r in parsed.collect()}
    assert errors == {"1001": None, "1002": None, "1003": None, "1004": "unreadable record line", "1005": "no FHR signal"}
    one = parsed.where("record_id = '1001'").first()
    assert (one["n_signals"], one["n_samples"], one["duration_seconds"]) == (2, 2000, 500.0)
    assert [s["name"] for s in one["signals"]] == ["FHR", "UC"] and one["signals"][0]["units"] == "bpm"
    assert one["comments"]["Gest. weeks"] == "37" and one["comments"]["Hypertension"] == "0"
    labels = {r["record_id"]: (r["ph"], r["label"]) for r in headers.outcome_labels(found).collect()}
    assert labels["1001"] == (7.14, 2) and labels["1002"] == (7.19, 1) and labels["1003"] == (None, 0)
    meta = headers.clinical_metadata(parsed)
    assert len(meta.columns) == 31
    row = meta.where("record_id = '1001'").first()
    assert (row["pH"], row["weight_g"], row["pos_stage2"], row["fhr_baseline"]) == (7.14, 2660.0, 14400, 0)


def test_missing_folder_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        headers.read_headers(spark, str(tmp_path / "nowhere")).count()


@pytest.mark.parametrize("frames", (128, 1 << 20))
def test_signals(spark, recording_folder, frames):
    parsed = headers.parse_headers(headers.read_headers(spark, recording_folder))
    samples = signals.read_signals(signals.signal_splits(parsed, recording_folder, frames))
    rows = samples.where("record_id = '1001'").orderBy("i").collect()
    assert len(rows) == 2000 and [r["i"] for r in rows] == list(range(2000))
    assert rows[3]["fhr"] is None and rows[4]["fhr"] == 141.0 and rows[10]["uc"] == 1.0
    assert samples.count() == 3000
    table = signals.as_table(samples)
    assert table.columns == ["record_id", "timestamp", "fhr1", "uc"]


def test_samples_table(spark, series_of, tmp_path):
    path = str(tmp_path / "samples")
    samples = series_of({"a": {"fhr": [140] * 30, "uc": [1] * 30}, "b": {"fhr": [150] * 10, "uc": [2] * 10}})
    signals.write_samples(samples, path, buckets=4)
    assert signals.read_samples(spark, path).count() == 40
    one = signals.read_record(spark, path, "b", buckets=4)
    assert one.count() == 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(record_id,b)" in plan
    with pytest.raises(LookupError):
        signals.read_record(spark, path, "c", buckets=4)


def test_window_counts(spark, series_of):
    lengths = {"a": 2400, "b": 2639, "c": 2640, "d": 5000, "e": 100}
    df = series_of({k: {"fhr": [140] * n} for k, n in lengths.items()})
    got = {r["record_id"]: r["count"] for r in window_bounds(df).groupBy("record_id").count().collect()}
    assert got == {"a": 1, "b": 1, "c": 2, "d": 11, "e": 1}
    n = spark.createDataFrame(list(lengths.items()), "record_id string, n long")
    assert {r[0]: r[1] for r in n.select("record_id", windows_from_length(F.col("n"))).collect()} == got


@pytest.mark.parametrize("size", (240, 480, 28_800))
def test_windows_match_slices(series_of, size):
    params = WindowParams(window_minutes=1.0, step_minutes=0.25)
    long = [130 + (i * 7) % 23 if i % 11 else None for i in range(700)]
    series = {"long": long, "short": [140.0, None, 150.0] * 20, "level": [140.1] * 240}
    got = prepare(windows(series_of({k: {"fhr": v} for k, v in series.items()}), params, size=size), params).collect()
    assert sorted(r["w"] for r in got if r["record_id"] == "long") == list(range(8))
    for r in got:
        x = np.array([np.nan if v is None else v for v in series[r["record_id"]]], dtype=float)
        x = x[r["start_idx"] : r["end_idx"]]
        if len(x) < 240:
            x = np.concatenate([x, np.full(240 - len(x), np.nanmean(x))])
        x = np.nan_to_num(x, nan=0.0)
        z = (x - x.mean()) / x.std() if x.std() > 1e-8 else x - x.mean()
        assert np.allclose(r["prepared"], z, atol=1e-5)


def test_encoder_contract(spark, series_of):
    params = WindowParams(window_minutes=1.0, step_minutes=0.25)
    ready = prepare(windows(series_of({"a": {"fhr": [140 + i % 9 for i in range(500)]}}), params), params)
    one = {r["w"]: r["embedding"] for r in embedding.embed(ready).collect()}
    two = {r["w"]: r["embedding"] for r in embedding.embed(ready.repartition(3)).collect()}
    assert one == two and all(len(v) == 1024 for v in one.values())
    assert np.allclose([np.linalg.norm(v) for v in one.values()], 1.0, atol=1e-5)
    with pytest.raises(Exception, match="1024-dimensional"):
        embedding.embed(ready, lambda x, s: x[:, :10]).collect()


def test_feature_names():
    names = features.feature_names()
    assert len(names) == 1035 and names[0] == "moment_emb_0000" and names[1024] == "baseline_norm"


@pytest.fixture(scope="module")
def built(spark, series_of, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dataset"))
    records = {
        f"r{k}": {
            "fhr": [130 + 5 * (k % 3) + ((i * (k + 3)) % (4 + 6 * (k % 3))) for i in range(1500)],
            "uc": [max(0, 90 - abs(i % 400 - 200)) for i in range(1500)],
        }
        for k in range(6)
    }
    samples = series_of(records)
    labels = spark.createDataFrame([(f"r{k}", k % 3) for k in range(6)] + [("gone", 1)], "record_id string, label int")
    params = dataset.DatasetParams(window=WindowParams(window_minutes=2.0, step_minutes=0.5))
    totals = dataset.build_dataset(spark, samples, labels, path, params)
    return path, totals, samples


def test_dataset(spark, built):
    path, totals, _ = built
    t = totals.first()
    assert (t["processed"], t["failed"], t["n_windows"], t["label_1"]) == (6, 1, 54, 18)
    rows = dataset.read_dataset(spark, path)
    assert rows.where("size(features) <> 1035").count() == 0
    with pytest.raises(FileNotFoundError):
        dataset.read_dataset(spark, path + "/none")


def test_training_and_scoring(spark, built, tmp_path):
    path, _, samples = built
    params = model.ClassifierParams(n_estimators=2, max_depth=2, n_folds=2)
    where = str(tmp_path / "model")
    figures = training.train_from(spark, path, where, params)
    assert figures["n_samples"] == 54 and 0 <= figures["mean_cv_score"] <= 1
    fitted, stored = model.load(spark, where)
    assert stored.n_estimators == 2
    rows = dataset.read_dataset(spark, path)
    predicted = model.predict(fitted, rows)
    for r in predicted.select("prediction", "probability").collect():
        assert sum(r["probability"]) == pytest.approx(1.0) and r["prediction"] in (0, 1, 2)
    voted = training.votes(fitted, rows)
    scored = {r["record_id"]: r for r in scoring.score(samples, votes=voted).collect()}
    assert len(scored) == 6 and all(r["final_category"] >= r["ml_prediction"] for r in scored.values())
    importance = model.importances(fitted)
    assert len(importance) == 1035 and sum(importance) == pytest.approx(1.0, abs=0.01)
    with pytest.raises(FileNotFoundError):
        model.load(spark, str(tmp_path / "nothing"))
    with pytest.raises(RuntimeError):
        model.predict(None, rows)


def test_fold_rules():
    assert metrics.reduced_folds(5, 3, 3) == 3
    assert metrics.reduced_folds(3, 1, 3) == 2
    assert metrics.reduced_folds(3, 50, 2) is None


def test_report_names_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 2), (7, 7)], "label int, prediction int")
    rows = {r["row"]: r for r in metrics.report(metrics.confusion(df), names=scalar.CLASS_NAMES).collect()}
    assert set(rows) == {"Normal (Cat 1)", "Intermediate (Cat 2)", "Pathological (Cat 3)", "Class_7", "accuracy", "macro avg", "weighted avg"}
    assert rows["Normal (Cat 1)"]["recall"] == 0.5 and rows["Normal (Cat 1)"]["f1"] == 0.667
    assert rows["Intermediate (Cat 2)"]["precision"] == 0.0 and rows["accuracy"]["f1"] == 0.75


def test_folds_are_balanced(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    got = metrics.stratified_folds(df, 4, ["id"]).groupBy("label", "fold").count().collect()
    assert sorted((r["label"], r["count"]) for r in got) == [(0, 225)] * 4 + [(1, 25)] * 4


@pytest.mark.skipif("CTG_HEADER_DIR" not in os.environ, reason="needs a folder of public header files")
def test_public_headers(spark):
    found = headers.read_headers(spark, os.environ["CTG_HEADER_DIR"])
    labels = headers.outcome_labels(found)
    parsed = headers.parse_headers(found)
    assert {r[0]: r[1] for r in labels.groupBy("label").count().collect()} == {0: 375, 1: 72, 2: 105}
    counted = parsed.select("record_id", windows_from_length(F.col("n_samples")).alias("w"), "n_samples").join(labels, "record_id")
    by_label = {r[0]: r[1] for r in counted.groupBy("label").agg(F.sum("w")).collect()}
    assert by_label == {0: 23_993, 1: 4_797, 2: 7_149}
    first = counted.orderBy("record_id").limit(50)
    assert {r[0]: r[1] for r in first.groupBy("label").agg(F.sum("w")).collect()} == {0: 2_047, 1: 391, 2: 802}
    assert counted.agg(F.sum("n_samples")).first()[0] == 9_825_177
    assert parsed.where("error is not null").count() == 0


def test_ingest_job_and_rule_only_score(spark, recording_folder, tmp_path):
    from cardiolake.plans.ingest import ingest

    tables = ingest(spark, recording_folder, str(tmp_path / "lake"), buckets=4)
    assert tables["records"].count() == 3 and tables["labels"].count() == 5
    assert sorted(r["record_id"] for r in tables["quarantine"].collect()) == ["1004", "1005"]
    assert tables["samples"].count() == 3000
    scored = scoring.score(tables["samples"])
    assert sorted(r["record_id"] for r in scored.collect()) == ["1001", "1002", "1003"]
    assert ingest(spark, recording_folder, str(tmp_path / "two"), limit=2, buckets=4)["records"].count() == 2


def test_broken_signal_files_are_set_apart(spark, tmp_path):
    from cardiolake.plans.ingest import ingest

    def record(name, file_bytes, fmt="16", second=None):
        (tmp_path / f"{name}.hea").write_text(
            f"{name} 2 4 100\n{name}.dat {fmt} 100(0)/bpm 12 0 0 0 0 FHR\n{second or name + '.dat'} 16 100(0)/nd 12 0 0 0 0 UC\n#pH 7.20\n"
        )
        if file_bytes is not None:
            (tmp_path / f"{name}.dat").write_bytes(bytes(file_bytes))

    record("good", 400)
    record("longer", 402)
    record("short", 399)
    record("absent", None)
    record("packed", 400, fmt="212")
    record("spread", 400, second="good.dat")
    tables = ingest(spark, str(tmp_path), str(tmp_path / "lake"), buckets=2)
    errors = {r["record_id"]: r["error"] for r in tables["quarantine"].collect()}
    assert set(errors) == {"short", "absent", "packed", "spread"}
    assert "short: 399 of 400" in errors["short"] and "missing" in errors["absent"]
    assert {r["record_id"]: r["n"] for r in tables["samples"].groupBy("record_id").agg(F.count("*").alias("n")).collect()} == {"good": 100, "longer": 100}


def test_headers_are_parsed_once(spark):
    """A condition on the outcome repeats no parsing, comments cost only those who read them, and nothing changes."""
    text = HEADER.format(id="7", n=9, ph="7.1") + "#pH  6.9\n#odd\n# two words  x\n#-- no pair\n"
    rows = spark.createDataFrame([("7", text), ("8", "8 one 4 9"), ("9", None)], "record_id string, content string")
    parsed = headers.parse_headers(rows.repartition(2))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    used = plan(parsed.where("error is null").select("record_id", "signals", "error"))
    assert used.count("split(content") == 1 and "[^-]" not in used
    assert plan(headers.clinical_metadata(parsed.where("error is null"))).count("split(content") == 1
    found = {r["record_id"]: r for r in parsed.collect()}
    assert [found[k]["error"] for k in "789"] == [None, "unreadable record line", "unreadable record line"]
    assert found["7"]["comments"]["pH"] == "7.1" and found["7"]["comments"]["two words"] == "x"
    assert not {"odd", "-- no", "-- Outcome"} & set(found["7"]["comments"]) and found["8"]["comments"] == {}
    assert found["9"]["comments"] is None and len(found["7"]["signals"]) == 2
