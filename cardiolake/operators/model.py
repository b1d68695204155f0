"""Boosted-tree classifier over feature rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.functions import scalar
from cardiolake.operators import boosting, metrics
from cardiolake.operators.boosting import Forest, Trees
from cardiolake.operators.staging import scope


@dataclass(frozen=True)
class ClassifierParams:
    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.1
    min_child_weight: float = 1.0
    subsample: float = 0.8
    colsample: float = 0.8
    min_gain: float = 0.0
    reg_lambda: float = 1.0
    max_bins: int = 32
    n_folds: int = 5
    seed: int = 42
    use_class_weights: bool = True


@dataclass
class TrainingResult:
    model: Forest
    scores: list[float]
    summary: DataFrame  # mean, deviation and best of the fold scores
    cells: DataFrame  # confusion cells on the training data
    report: DataFrame


def fit(df: DataFrame, params: ClassifierParams, folds: int = 0, key: Sequence[str] = ("record_id", "w")) -> list[Forest]:
    """Forests for ``label`` that leave out folds 0, 1, ..., then one of all rows, grown side by side.

    One softmax over all classes, or the logistic function of one margin for two classes.
    """
    classes = sorted(int(r[0]) for r in df.select("label").distinct().collect())  # a row a class
    rows = boosting.as_arrays(df).withColumn("y", metrics.by_class("label", {c: i for i, c in enumerate(classes)}))
    with scope():
        return boosting.grow(
            rows, classes, params.n_estimators, params.max_depth, params.learning_rate, params.subsample, params.colsample,
            params.reg_lambda, params.min_child_weight, params.min_gain, params.max_bins, folds, key, params.seed,
        )


def predict(model: Forest | None, df: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``probability array<double>``, the softmax of the class margins."""
    if model is None:
        raise RuntimeError("model is not trained")
    return boosting.scored(df, [model])


def train(
    df: DataFrame,
    params: ClassifierParams = ClassifierParams(),
    validate: bool = True,
    key: Sequence[str] = ("record_id", "w"),
    group: str | None = None,
) -> TrainingResult:
    """Fold scores, then metrics of a fit on all rows on the training data.

    Folds are stratified by row; ``group`` deals whole groups instead, which keeps overlapping
    windows of one record together. The forests of all folds and the final one grow in the same
    passes. Only fold scores, class counts and trees reach the driver.
    """
    df = boosting.as_arrays(df).withColumn("label", F.col("label").cast("int"))
    if params.use_class_weights:
        df = metrics.with_weights(df)
    if validate:
        df = (
            metrics.grouped_folds(df, params.n_folds, group, params.seed)
            if group
            else metrics.stratified_folds(df, params.n_folds, key, "label", params.seed)
        )
    forests = fit(df, params, params.n_folds if validate else 0, key)
    scores: list[float] = []
    if validate:
        held = boosting.scored(df, forests, "fold")
        cells = held.groupBy("fold", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
        scores = [r["macro_f1"] for r in metrics.macro_f1(cells, ["fold"]).orderBy("fold").collect()]  # a row a fold
    cells = metrics.confusion(predict(forests[-1], df))
    fold_scores = df.sparkSession.createDataFrame([(float(s),) for s in scores], "score double")
    return TrainingResult(
        forests[-1], scores, metrics.cv_summary(fold_scores), cells, metrics.report(cells, names=scalar.CLASS_NAMES)
    )


def importances(model: Forest) -> list[float]:
    """Mean gain of each feature's splits, as shares of one."""
    return model.importances()


def save(model: Forest | None, params: ClassifierParams, path: str, spark: SparkSession) -> None:
    """Trees, bins and parameters, below one folder."""
    if model is None:
        raise RuntimeError("model is not trained")
    rows = [
        (turn, k, i, int(t.feature[k, i]), int(t.bin[k, i]), float(t.value[k, i]), float(t.gain[k, i]))
        for turn, t in enumerate(model.rounds)
        for k in range(len(t.value))
        for i in range(t.value.shape[1])
    ]
    root = path.rstrip("/")
    schema = "turn int, k int, node int, feature int, bin int, value double, gain double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/trees")
    cuts = [(j, c.tolist()) for j, c in enumerate(model.cuts)]
    spark.createDataFrame(cuts, "feature int, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(f"{root}/cuts")
    config = json.dumps(asdict(params) | {"classes": model.classes})
    spark.createDataFrame([(config,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/config")


def load(spark: SparkSession, path: str) -> tuple[Forest, ClassifierParams]:
    """Fails with FileNotFoundError without a model; a missing config means defaults and classes 0, 1, ..."""
    root = path.rstrip("/")
    try:
        rows = spark.read.parquet(f"{root}/trees").orderBy("turn", "k", "node").collect()  # rounds x classes x nodes
        cuts = spark.read.parquet(f"{root}/cuts").orderBy("feature").collect()
    except PySparkException as e:
        raise FileNotFoundError(f"no model under {path}") from e
    width = max((r["k"] for r in rows), default=-1) + 1
    try:
        stored = json.loads(spark.read.text(f"{root}/config").first()["value"])
    except PySparkException:
        stored = {"classes": [0, 1] if width == 1 else list(range(width))}
    classes = stored.pop("classes")
    turns = max((r["turn"] for r in rows), default=-1) + 1
    shape = (turns, width, -1)
    parts = [np.array([r[c] for r in rows], t).reshape(shape) if rows else [] for c, t in (("feature", np.int32), ("bin", np.int32), ("value", float), ("gain", float))]
    rounds = [Trees(*(p[turn] for p in parts)) for turn in range(turns)]
    return Forest(classes, [np.array(r["cuts"], float) for r in cuts], rounds), ClassifierParams(**stored)
