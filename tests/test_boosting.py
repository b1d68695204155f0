"""Boosting against a loop that knows rows only: same splits, same probabilities, whatever the layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardiolake.operators import boosting, model


def slow_boosting(x, y, weight, classes, rounds, depth, rate, penalty=1.0, least=1.0):
    """Every threshold between two different values of every feature, row by row."""
    n, width = len(x), 1 if classes == 2 else classes
    margins = [[0.0] * width for _ in range(n)]
    for _ in range(rounds):
        steps = []
        for k in range(width):
            g, h = [], []
            for i in range(n):
                if width == 1:
                    p, t = 1 / (1 + np.exp(-margins[i][0])), float(y[i] == 1)
                    h.append(weight[i] * p * (1 - p))
                else:
                    e = [np.exp(m - max(margins[i])) for m in margins[i]]
                    p, t = e[k] / sum(e), float(y[i] == k)
                    h.append(weight[i] * 2 * p * (1 - p))
                g.append(weight[i] * (p - t))

            def grown(rows, level):
                G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
                splits = []
                for j in range(x.shape[1]) if level < depth else ():
                    values = sorted({x[i, j] for i in rows})
                    for cut in values[:-1]:
                        left = [i for i in rows if x[i, j] <= cut]
                        a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                        if b < least or H - b < least:
                            continue
                        gain = 0.5 * (a * a / (b + penalty) + (G - a) ** 2 / (H - b + penalty) - G * G / (H + penalty))
                        splits.append((gain, set(left)))
                most = max((s[0] for s in splits), default=0.0)
                if most <= 1e-7:
                    return {i: -rate * G / (H + penalty) for i in rows}
                left = next(rows_ for gain, rows_ in splits if gain >= most * (1 - 1e-7))
                return grown([i for i in rows if i in left], level + 1) | grown([i for i in rows if i not in left], level + 1)

            steps.append(grown(list(range(n)), 0))
        for i in range(n):
            for k in range(width):
                margins[i][k] += steps[k][i]
    if width == 1:
        p = [1 / (1 + np.exp(-m[0])) for m in margins]
        return [[1 - v, v] for v in p]
    return [[np.exp(v) / sum(np.exp(w) for w in m) for v in m] for m in margins]


def made(n, classes, seed):
    """Few distinct values, so that every one is a bin end, and labels that two features explain in part."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, 4)) / 4.0
    y = ((x[:, 0] > 1).astype(int) + (x[:, 2] > 1.2) * (rng.random(n) < 0.8)) % classes
    return x, y, np.where(y == 0, 0.5, 1.5)


@pytest.mark.parametrize("classes,parts", [(2, 3), (3, 1), (3, 4)])
def test_equals_the_loop(spark, classes, parts):
    x, y, weight = made(160, classes, classes)
    rows = [(i, x[i].tolist(), int(y[i]), float(weight[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "i long, features array<double>, y int, weight double").repartition(parts)
    forest = boosting.grow(df, list(range(classes)), rounds=13, depth=3, rate=0.3, key=["i"])[-1]
    got = {r["i"]: r["probability"] for r in boosting.scored(df, [forest]).collect()}
    expected = slow_boosting(x, y, weight, classes, 13, 3, 0.3)
    for i, p in enumerate(expected):
        assert got[i] == pytest.approx(p, abs=1e-6)


def test_drawn_rows_and_columns_do_not_depend_on_the_layout(spark):
    x, y, weight = made(200, 3, 5)
    rows = [(i, x[i].tolist(), int(y[i]), i % 4) for i in range(len(x))]
    df = spark.createDataFrame(rows, "i long, features array<double>, y int, fold int")
    grown = [
        boosting.grow(d, [0, 1, 2], 4, 3, row_share=0.7, column_share=0.5, folds=4, key=["i"])
        for d in (df.repartition(1), df.repartition(5).orderBy(F.desc("i")))
    ]
    for a, b in zip(*grown):
        for s, t in zip(a.rounds, b.rounds):
            assert (s.feature == t.feature).all() and (s.value == t.value).all()
            # Half of four columns a tree.
            assert all(len(set(row[row >= 0])) <= 2 for row in s.feature)


def test_forests_of_folds_never_see_their_fold(spark):
    """A forest beside others equals one grown alone without the rows of its fold."""
    x, y, _ = made(120, 3, 9)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), i % 3) for i in range(len(x))], "i long, features array<double>, y int, fold int")
    beside = boosting.grow(df, [0, 1, 2], 3, 3, folds=3, key=["i"])
    for fold in range(3):
        alone = boosting.grow(df.where(F.col("fold") != fold).drop("fold"), [0, 1, 2], 3, 3, key=["i"])[-1]
        a, b = (f.probabilities(x) for f in (beside[fold], alone))
        assert a == pytest.approx(b, abs=1e-9)


def test_levels_in_several_passes(spark, monkeypatch):
    x, y, _ = made(150, 3, 11)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(len(x))], "i long, features array<double>, y int")
    at_once = boosting.grow(df, [0, 1, 2], 2, 4, key=["i"])[-1]
    monkeypatch.setattr(boosting, "_SUMS", 4 * 32 * 16 * 3)  # three nodes a pass
    monkeypatch.setattr(boosting, "_FAN", 1)
    parted = boosting.grow(df.repartition(3), [0, 1, 2], 2, 4, key=["i"])[-1]
    assert all((s.value == t.value).all() for s, t in zip(at_once.rounds, parted.rounds))


def test_saved_model(spark, tmp_path):
    x, y, _ = made(90, 2, 3)
    df = spark.createDataFrame([(str(i % 9), i, x[i].tolist(), int(y[i]) * 2) for i in range(len(x))], "record_id string, w long, features array<double>, label int")
    params = model.ClassifierParams(n_estimators=3, max_depth=2, n_folds=3)
    result = model.train(df, params, group="record_id")
    assert len(result.scores) == 3 and result.model.classes == [0, 2]
    model.save(result.model, params, str(tmp_path / "m"), spark)
    again, stored = model.load(spark, str(tmp_path / "m"))
    assert stored == params
    assert model.predict(again, df).select("w", "prediction", "probability").orderBy("w").collect() == (
        model.predict(result.model, df).select("w", "prediction", "probability").orderBy("w").collect()
    )
    assert sum(model.importances(again)) == pytest.approx(1.0)
    # Nothing to learn: every class has the same share.
    level = model.train(df.withColumn("features", F.array(F.lit(1.0))), params, validate=False)
    assert model.importances(level.model) == [0.0]


def test_one_part_of_input_is_read_by_all_cores(spark, monkeypatch):
    x, y, _ = made(200, 3, 7)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(len(x))], "i long, features array<double>, y int").coalesce(1)
    alone, parts, real = boosting.grow(df, [0, 1, 2], 2, 2, column_share=0.5, key=["i"])[-1], [], boosting.written
    monkeypatch.setattr(boosting, "_ROWS_A_TASK", 20, raising=False)
    monkeypatch.setattr(boosting, "written", lambda d: parts.append(d.rdd.getNumPartitions()) or real(d))
    shared = boosting.grow(df, [0, 1, 2], 2, 2, column_share=0.5, key=["i"])[-1]
    assert parts == [1, spark.sparkContext.defaultParallelism]
    assert all((s.value == t.value).all() and (s.gain == t.gain).all() for s, t in zip(alone.rounds, shared.rounds))
