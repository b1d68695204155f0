"""Physical plans that must hold at scale."""

import re

import pytest

from cardiolake.operators.baseline import baseline
from cardiolake.operators.clean import clean
from cardiolake.operators.decelerations import decelerations
from cardiolake.operators.staging import stage
from cardiolake.params import WindowParams
from cardiolake.plans import dataset


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture()
def samples(series_of):
    n = 900
    return series_of(
        {"a": {"fhr": [140 - 40 * (200 < i % 400 < 300) for i in range(n)], "uc": [i % 90 for i in range(n)]}}
    )


def plan(df):
    return [re.sub(r"^[\s:|+\-*()0-9]*", "", l) for l in df._jdf.queryExecution().executedPlan().toString().split("\n")]


def exchanges_of_raw_rows(lines):
    """Exchanges that move rows no aggregate or join has reduced before."""
    out = []
    for k, line in enumerate(lines):
        if line.startswith("Exchange"):
            for below in lines[k + 1 :]:
                if re.match(r"(Project|Filter|ColumnarToRow|Sort)\b", below):
                    continue
                if re.match(r"(FileScan|ArrowEvalPython)", below):
                    out.append(line)
                break
    return out


def test_clean_moves_samples_once(samples):
    lines = plan(clean(samples, ("fhr", "uc")))
    assert sum(l.startswith("Exchange") for l in lines) == 1
    assert sum(l.startswith("Sort ") for l in lines) == 2


def test_staged_rules_do_not_move_samples(samples, no_broadcast):
    staged = stage(clean(samples, ("fhr", "uc")).select("record_id", "chunk", "i", "fhr", "uc"))
    lines = plan(decelerations(staged, baseline(staged)))
    assert any(l.startswith("FileScan") for l in lines)
    assert exchanges_of_raw_rows(lines) == []
    assert sum("ShuffledHashJoin" in l for l in lines) >= 3


def test_embeddings_are_not_shuffled(samples, no_broadcast):
    params = dataset.DatasetParams(window=WindowParams(window_minutes=1.0, step_minutes=0.5))
    lines = plan(dataset.feature_rows(samples, None, params))
    at = next(k for k, l in enumerate(lines) if l.startswith("ArrowEvalPython"))
    assert not any(l.startswith("Exchange") for l in lines[:at])


def test_staged_scan_reads_only_its_columns(samples):
    staged = stage(clean(samples, ("fhr", "uc")).select("record_id", "chunk", "i", "fhr", "uc"))
    scan = next(l for l in plan(baseline(staged)) if l.startswith("FileScan"))
    assert "fhr#" in scan and "uc#" not in scan
