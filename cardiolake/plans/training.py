"""Training and classifier scoring jobs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.operators import decide, metrics, model
from cardiolake.operators.boosting import Forest
from cardiolake.plans.dataset import read_dataset


def train_from(
    spark: SparkSession,
    data_path: str,
    model_path: str,
    params: model.ClassifierParams = model.ClassifierParams(max_depth=5, n_folds=3),
    group: str | None = None,
) -> dict:
    """Train on a written dataset, save the model, return the headline figures.

    With fewer than three classes labels are made contiguous and validation is skipped; folds
    shrink to the smallest class.
    """
    rows = read_dataset(spark, data_path)
    counts = {r["label"]: r["n"] for r in metrics.class_counts(rows).collect()}  # one row per class
    if len(counts) < 3:
        rows = metrics.contiguous_labels(rows).withColumnRenamed("new_label", "label")
    folds = metrics.reduced_folds(params.n_folds, min(counts.values()), len(counts))
    used = replace(params, n_folds=folds or params.n_folds)
    result = model.train(rows, used, validate=folds is not None, group=group)
    model.save(result.model, used, model_path, spark)
    summary = result.summary.first()
    return {
        "mean_cv_score": summary["mean_score"],
        "std_cv_score": summary["std_score"],
        "best_score": summary["best_score"],
        "n_samples": sum(counts.values()),
        "model_path": model_path,
    }


def votes(fitted: Forest, rows: DataFrame) -> DataFrame:
    """``record_id, ml_prediction, confidence`` from window predictions."""
    predicted = model.predict(fitted, rows).select("record_id", "w", "prediction", "probability")
    return decide.majority_vote(predicted).join(metrics.mean_confidence(predicted), "record_id")


def tables_of(result: model.TrainingResult) -> dict[str, DataFrame]:
    """Training outputs as tables."""
    spark = result.cells.sparkSession
    ranked = [(i, v) for i, v in enumerate(model.importances(result.model))]
    return {
        "summary": result.summary,
        "confusion": result.cells,
        "report": result.report,
        "importance": spark.createDataFrame(ranked, "position int, importance double").orderBy(
            F.desc("importance")
        ),
    }
