"""Every series operator gives the loop result, however small the chunks are."""

import random

import pytest
from brute import clean as loop_clean
from brute import decelerations as loop_decels
from brute import interpolate as loop_interpolate
from brute import peaks as loop_peaks
from brute import percentile as loop_percentile
from brute import runs as loop_runs

from cardiolake.operators import contractions, series
from cardiolake.operators.clean import clean, gap_regions, interpolate
from cardiolake.operators.decelerations import decelerations
from cardiolake.params import TachysystoleParams

SIZES = (7, 60, 28_800)


def random_heart_rate(seed, n):
    r = random.Random(seed)
    out, v, k = [], 140.0, 0
    while len(out) < n:
        k = r.choice([1, 3, 10, 39, 40, 41, 60])
        kind = r.random()
        for _ in range(k):
            v = min(200.0, max(80.0, v + r.choice([-3, -1, 0, 1, 3])))
            if kind < 0.2:
                out.append(None)
            elif kind < 0.3:
                out.append(0.0)
            elif kind < 0.4 and r.random() < 0.3:
                out.append(v + 45)
            else:
                out.append(v)
    return out[:n]


@pytest.fixture(scope="module")
def records():
    made = {f"r{k}": {"fhr": random_heart_rate(k, n)} for k, n in enumerate((400, 233, 60, 41, 12))}
    made["empty"] = {"fhr": [None] * 50}
    made["short_gap_only"] = {"fhr": [0.0] * 5}
    made["ends"] = {"fhr": [None] * 5 + [140.0] * 20 + [0.0] * 40}
    return made


def by_record(df, *columns):
    out = {}
    for row in df.collect():
        out.setdefault(row["record_id"], []).append(tuple(row[c] for c in columns))
    return {k: sorted(v, key=lambda t: t[0]) for k, v in out.items()}


@pytest.mark.parametrize("size", SIZES)
def test_clean(series_of, records, size):
    got = by_record(clean(series_of(records), size=size), "i", "fhr", "fhr_filled")
    for name, columns in records.items():
        values, filled = loop_clean(columns["fhr"])
        assert [g[1] for g in got[name]] == pytest.approx(values), name
        assert [g[2] for g in got[name]] == filled, name


@pytest.mark.parametrize("size", SIZES)
def test_clean_masks_add_up(series_of, records, size):
    df = clean(series_of(records), size=size)
    assert df.where("fhr_invalid <> (fhr_filled or fhr_unfilled)").count() == 0
    assert df.where("fhr_filled and fhr_unfilled").count() == 0
    assert df.where("fhr_unfilled and fhr is not null").count() == 0


@pytest.mark.parametrize("size", (5, 28_800))
@pytest.mark.parametrize("method", ("linear", "nearest"))
def test_interpolate(series_of, records, size, method):
    got = by_record(interpolate(series_of(records), "fhr", method, size=size), "i", "fhr")
    for name, columns in records.items():
        assert [g[1] for g in got[name]] == pytest.approx(loop_interpolate(columns["fhr"], method)), name


@pytest.mark.parametrize("size", (3, 10, 28_800))
def test_gap_regions(series_of, records, size, monkeypatch):
    monkeypatch.setattr(series, "FAN", 4)
    got = by_record(gap_regions(series_of(records), "fhr", size=size), "start_idx", "end_idx")
    for name, columns in records.items():
        assert got.get(name, []) == loop_runs([v is None for v in columns["fhr"]]), name


def test_percentiles(series_of, records):
    for q in (0.5, 0.75, 0.0, 1.0):
        got = dict(series.percentiles(series_of(records), "fhr", q).collect())
        for name, columns in records.items():
            present = [v for v in columns["fhr"] if v is not None]
            if present:
                assert got[name] == pytest.approx(loop_percentile(present, q))
            else:
                assert name not in got


@pytest.fixture(scope="module")
def waves():
    made = {}
    for k in range(14):
        r = random.Random(100 + k)
        top = r.choice([3, 8, 40])
        n = r.choice([90, 200, 351])
        v, out = top // 2, []
        for _ in range(n):
            v = min(top, max(0, v + r.choice([-1, 0, 0, 1]) * r.choice([1, 1, 2])))
            out.append(float(v))
        made[f"w{k}"] = {"uc": out}
    made["flat"] = {"uc": [0.0] * 100}
    made["level"] = {"uc": [7.0] * 100}
    made["ramps"] = {"uc": [float(10 * (i % 2) + i) for i in range(200)]}
    made["slope"] = {"uc": [float(400 - i + 3 * (i % 2)) for i in range(300)]}
    return made


@pytest.mark.parametrize("size", (11, 64, 28_800))
def test_contraction_count_any_length(series_of, waves, size, monkeypatch):
    monkeypatch.setattr(series, "FAN", 3)
    params = TachysystoleParams(min_distance_seconds=3.0)
    got = dict(contractions.contraction_count(series_of(waves), params, size=size).collect())
    for name, columns in waves.items():
        n = len(columns["uc"])
        kept = int(n / 4.0 / 60 * 60 * 4.0)
        assert got[name] == len(loop_peaks(columns["uc"][n - kept :], 12)), name


def test_tail_contractions_match(series_of, waves):
    params = TachysystoleParams(min_distance_seconds=3.0)
    rows = contractions.tachysystole(series_of(waves), params, size=32).collect()
    for row in rows:
        assert row["contraction_indices"] == loop_peaks(waves[row["record_id"]]["uc"], 12)


@pytest.mark.parametrize("size", (50, 240, 28_800))
def test_decelerations(series_of, spark, size, monkeypatch):
    monkeypatch.setattr(series, "FAN", 4)
    records, bases = {}, []
    for k in range(8):
        r = random.Random(k)
        fhr, uc = [], []
        while len(fhr) < 1500:
            span, floor = r.choice([40, 60, 90, 300, 700]), r.choice([60, 90, 100, 120])
            for j in range(span):
                shape = min(1, j / (span / 3), (span - j) / (span / 4))
                bump = 25 if r.random() < 0.1 and k % 2 else 0
                fhr.append(round(140 - (140 - floor) * shape) + bump * (j == span // 2))
            fhr += [r.choice([140.0, 152.0, None])] * r.choice([20, 100])
        fhr = fhr[:1500]
        mode = k % 4
        for i in range(len(fhr)):
            uc.append([max(0, 60 - abs(i % 400 - 200)), 0.0, None, None if i % 3 else 0.0][mode])
        records[f"d{k}"] = {"fhr": fhr, "uc": uc}
        bases.append((f"d{k}", 140.0))
    base = spark.createDataFrame(bases, "record_id string, value double")
    events = decelerations(series_of(records), base, size=size).collect()
    got = {}
    for e in events:
        got.setdefault(e["record_id"], []).append(
            (e["start_idx"], e["end_idx"], e["nadir_idx"], e["decel_type"], e["lag_seconds"], tuple(e["severity_signs"]))
        )
    seen = set()
    for name, columns in records.items():
        expected = loop_decels(columns["fhr"], columns["uc"], 140.0)
        assert sorted(got.get(name, [])) == expected, name
        seen |= {e[3] for e in expected} | {s.split("(")[0] for e in expected for s in e[5]}
    assert {"Prolonged", "Late", "Variable", "Unclassified"} <= seen, seen


def test_percentiles_of_any_range(series_of):
    """Tiny, huge, negative, level and dense values in one key: the same as sorting."""
    r = random.Random(8)
    made = {
        "wide": [1e-300, 1e300, -1e300, 0.0, -1e-300, 5e-324, 3.0, -3.0, 1e16, 1e16 + 2],
        "one": [7.25],
        "level": [1e-9] * 50,
        "dense": [1.0 + k * 2.0**-52 for k in r.sample(range(3000), 700)],
        "mixed": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(400)] + [None] * 9,
        "ties": [float(r.randrange(4)) for _ in range(301)],
    }
    df = series_of({name: {"x": values} for name, values in made.items()})
    for q in (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0):
        got = dict(series.percentiles(df, "x", q).collect())
        for name, values in made.items():
            present = [v for v in values if v is not None]
            assert got[name] == pytest.approx(loop_percentile(present, q), rel=1e-15), (name, q)
