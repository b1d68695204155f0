"""Classifier metrics, class weights and folds as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.functions import scalar
from cardiolake.operators import series


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight ``n / (k * count)`` per class; one row per class."""
    counts = class_counts(df, label)
    over = Window.partitionBy()
    return counts.select(
        "label",
        "n",
        (F.sum("n").over(over) / (F.count(F.lit(1)).over(over) * F.col("n"))).alias("weight"),
    )


def by_class(column: str, values: dict) -> Column:
    """A literal CASE over the classes: no join, so a class that holds most rows moves nowhere."""
    out = F.lit(None)
    for known, value in values.items():
        out = F.when(F.col(column) == F.lit(known), F.lit(value)).otherwise(out)
    return out


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add the balanced weight of each row's class; rows without a label are left out.

    One count per class reaches the driver, so this runs one aggregate when it is called.
    """
    weights = {r["label"]: r["weight"] for r in class_weights(df, label).where("label is not null").collect()}
    return df.where(F.col(label).isNotNull()).withColumn("weight", by_class(label, weights).cast("double"))


def stratified_folds(
    df: DataFrame, folds: int, key: Sequence[str], label: str = "label", seed: int = 42
) -> DataFrame:
    """Add ``fold``: shuffled by a seeded hash and dealt out evenly inside each class.

    Ranks are built from hash-prefix buckets, so a class that holds most rows is not sorted in
    one task.
    """
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    hashed = df.withColumn("_h", F.md5(text))
    ranks = series.ranked(hashed, [label], "_h", F.substring("_h", 1, 4), "_rank")
    return ranks.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_h", "_rank")


def grouped_folds(df: DataFrame, folds: int, key: str = "record_id", seed: int = 42) -> DataFrame:
    """Add ``fold`` by record, so overlapping windows never sit on both sides.

    Records are dealt out in hashed order: fold sizes differ by one record at most. Fewer records
    than folds fail, as some fold would be empty.
    """
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    groups = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", F.md5(text))
    ranks = series.ranked(groups, [], "_h", F.substring("_h", 1, 4), "_rank")
    if ranks.limit(folds).count() < folds:
        raise ValueError(f"{folds} folds need at least as many different values of {key}")
    dealt = ranks.select(key, ((F.col("_rank") - 1) % folds).cast("int").alias("fold"))
    return df.join(dealt, key)


def contiguous_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Map the labels in use to 0, 1, ...; ``old_label`` keeps the inverse map."""
    known = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())
    new = by_class("old_label", {old: i for i, old in enumerate(known)}).cast("int")
    return df.where(F.col(label).isNotNull()).withColumnRenamed(label, "old_label").withColumn("new_label", new)


def reduced_folds(requested: int, smallest_class: int, n_classes: int) -> int | None:
    """Folds to use; None when there are too few classes to validate."""
    if n_classes < 3:
        return None
    return requested if smallest_class >= requested else max(2, smallest_class)


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Cell counts ``label, prediction, n``: everything below derives from this small table."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(cells: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Pivoted matrix with a zero in empty cells."""
    wide = cells.groupBy("label").pivot("prediction", list(classes)).agg(F.sum("n"))
    named = wide.select("label", *[F.col(str(c)).alias(f"predicted_{c}") for c in classes])
    return named.na.fill(0)


def per_class(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs (per key); undefined ratios are 0."""
    sides = cells.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("c"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
                    F.col("n").alias("actual"),
                    F.lit(0).cast("long").alias("predicted"),
                ),
                F.struct(
                    F.col("prediction").alias("c"),
                    F.lit(0).cast("long").alias("hit"),
                    F.lit(0).cast("long").alias("actual"),
                    F.col("n").alias("predicted"),
                ),
            )
        ).alias("s")
    ).select(*keys, "s.*")
    summed = sides.groupBy(*keys, F.col("c").alias("label")).agg(
        F.sum("hit").alias("hit"), F.sum("actual").alias("support"), F.sum("predicted").alias("predicted")
    )

    def ratio(a: str, b: Column) -> Column:
        return F.when(b > 0, F.col(a) / b).otherwise(0.0)

    return summed.select(
        *keys,
        "label",
        ratio("hit", F.col("predicted")).alias("precision"),
        ratio("hit", F.col("support")).alias("recall"),
        F.when(
            F.col("support") + F.col("predicted") > 0,
            2 * F.col("hit") / (F.col("support") + F.col("predicted")),
        )
        .otherwise(0.0)
        .alias("f1"),
        "support",
        "hit",
    )


def macro_f1(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the per-class F1 values (not the support-weighted one), per key."""
    return per_class(cells, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def report(cells: DataFrame, digits: int = 3, names: dict | None = None) -> DataFrame:
    """Rows per class (by name where known) plus accuracy, macro average and weighted average."""
    classes = per_class(cells)
    figures = ("precision", "recall", "f1")
    label = F.col("label").cast("string")
    if names:
        known = scalar.lookup(F.col("label"), names)
        label = F.coalesce(known, F.concat(F.lit("Class_"), label))
    rows = classes.select(label.alias("row"), *figures, "support")
    total = F.sum("support")
    totals = classes.agg(
        total.alias("support"),
        (F.sum("hit") / total).alias("accuracy"),
        *[F.avg(f).alias(f"macro_{f}") for f in figures],
        *[(F.sum(F.col(f) * F.col("support")) / total).alias(f"weighted_{f}") for f in figures],
    )
    accuracy = F.struct(
        F.lit("accuracy").alias("row"),
        *[F.col("accuracy").alias(f) for f in figures],
        F.col("support"),
    )

    def average(kind: str) -> Column:
        return F.struct(
            F.lit(f"{kind} avg").alias("row"),
            *[F.col(f"{kind}_{f}").alias(f) for f in figures],
            F.col("support"),
        )

    summary = totals.select(
        F.explode(F.array(accuracy, average("macro"), average("weighted"))).alias("r")
    ).select("r.*")
    return rows.unionByName(summary).select(
        "row", *[F.round(f, digits).alias(f) for f in figures], "support"
    )


def cv_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean, population deviation and maximum of fold scores; zeros without any."""
    zero = F.lit(0.0)
    return scores.agg(
        F.coalesce(F.avg(score), zero).alias("mean_score"),
        F.coalesce(F.stddev_pop(score), zero).alias("std_score"),
        F.coalesce(F.max(score), zero).alias("best_score"),
    )


def mean_confidence(df: DataFrame, probability: str = "probability", key: str = "record_id") -> DataFrame:
    """Mean over windows of the largest class probability."""
    return df.groupBy(key).agg(F.avg(F.array_max(probability)).alias("confidence"))
