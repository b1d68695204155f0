"""Training data: feature rows for every window of every record, with labels and an audit."""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.operators import embedding, features, series
from cardiolake.operators.windows import prepare, windows
from cardiolake.params import CHUNK, WindowParams
from cardiolake.plans.scoring import RuleParams, clean_record_signals, rule_findings
from cardiolake.operators.staging import stage, written


@dataclass(frozen=True)
class DatasetParams:
    rules: RuleParams = field(default_factory=RuleParams)
    window: WindowParams = field(default_factory=WindowParams)
    limit: int | None = None


def window_rows(
    samples: DataFrame,
    labels: DataFrame | None = None,
    params: DatasetParams = DatasetParams(),
    encoder: embedding.Encoder = embedding.statistical_encoder,
    is_mock: bool = True,
    size: int = CHUNK,
    staged: bool = True,
) -> DataFrame:
    """``record_id, w, bounds, rule columns, features[, label], error`` of every window.

    A window that the encoder fails on has NULL features and the reason in ``error``.

    Findings and labels are joined while they are one row per record, then spread to
    ``(record, chunk)`` and met by the windows where those are built: window arrays and
    embeddings are never shuffled.
    """
    if params.limit:
        wanted = samples.select("record_id").distinct().orderBy("record_id").limit(params.limit)
        samples = samples.join(wanted, "record_id", "left_semi")
    cleaned = clean_record_signals(samples, params.rules, size)
    if staged:
        cleaned = stage(cleaned)
    findings = rule_findings(cleaned, params.rules, size=size)
    extra = []
    if labels is not None:
        findings = findings.join(labels.select("record_id", "label"), "record_id", "left").na.fill(0, ["label"])
        extra = ["label"]
    per_window = features.with_findings(
        windows(cleaned, params.window, size=size), series.per_chunk(findings, cleaned)
    )
    fused = features.fuse(embedding.embed(prepare(per_window, params.window), encoder, is_mock, isolate=True))
    return fused.select(
        "record_id",
        "w",
        "start_idx",
        "end_idx",
        "start_sec",
        "end_sec",
        "is_mock",
        "baseline",
        "variability_value",
        F.upper("variability_category").alias("variability_category"),
        "late_count",
        "variable_count",
        "tachysystole",
        "sinusoidal",
        "features",
        *extra,
        "error",
    )


def feature_rows(
    samples: DataFrame,
    labels: DataFrame | None = None,
    params: DatasetParams = DatasetParams(),
    encoder: embedding.Encoder = embedding.statistical_encoder,
    is_mock: bool = True,
    size: int = CHUNK,
    staged: bool = True,
) -> DataFrame:
    """The rows of ``window_rows`` whose window could be encoded."""
    return window_rows(samples, labels, params, encoder, is_mock, size, staged).where("error is null").drop("error")


def write_dataset(rows: DataFrame, path: str) -> None:
    """Rows by whether their window failed: readers of one side never open the files of the other."""
    failed = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
    rows.withColumn("failed", failed.cast("int")).write.mode("overwrite").partitionBy("failed").parquet(f"{path.rstrip('/')}/features")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Fails with FileNotFoundError where no dataset was written."""
    return _rows(spark, path).where("failed = 0").drop("failed", "error")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, w, start_idx, end_idx, error`` of the windows that the encoder failed on."""
    rows = _rows(spark, path).where("failed = 1")
    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    return rows.select("record_id", "w", "start_idx", "end_idx", error.alias("error"))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path.rstrip('/')}/features")
    except AnalysisException as e:
        raise FileNotFoundError(f"no dataset under {path}; build it first") from e


def audit(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Per record: windows written, label and whether it failed; totals follow by aggregation."""
    made = rows.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("label").alias("label")
    )
    return (
        records.select("record_id")
        .distinct()
        .join(made, "record_id", "left")
        .withColumn("failed", F.col("n_windows").isNull())
        .na.fill(0, ["n_windows"])
    )


def audit_totals(per_record: DataFrame) -> DataFrame:
    return per_record.agg(
        F.count_if(~F.col("failed")).alias("processed"),
        F.count_if("failed").alias("failed"),
        F.sum("n_windows").alias("n_windows"),
        *[F.sum(F.when(F.col("label") == k, F.col("n_windows")).otherwise(0)).alias(f"label_{k}") for k in (0, 1, 2)],
    )


def build_dataset(
    spark: SparkSession,
    samples: DataFrame,
    labels: DataFrame,
    path: str,
    params: DatasetParams = DatasetParams(),
    encoder: embedding.Encoder = embedding.statistical_encoder,
    is_mock: bool = True,
) -> DataFrame:
    """Write features, failed windows and audit; returns the totals.

    A window that the encoder fails on costs its own row only (``read_quarantine``). Records without
    samples, or without a window that could be encoded, are reported failed.
    """
    write_dataset(window_rows(samples, labels, params, encoder, is_mock), path)
    rows = read_dataset(spark, path)
    per_record = audit(labels, rows)
    per_record.write.mode("overwrite").parquet(f"{path.rstrip('/')}/audit")
    totals = audit_totals(spark.read.parquet(f"{path.rstrip('/')}/audit"))
    if totals.first()["processed"] == 0:
        raise RuntimeError("no record was processed")
    return totals


# --- builds that go on where they ended --------------------------------------------------------


def params_key(params: DatasetParams, encoder_name: str) -> str:
    """Names everything but the samples that a record's rows depend on."""
    return hashlib.sha256(f"{params!r}|{encoder_name}".encode()).hexdigest()


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, version, label, params, turn, n_windows`` of every finished part of a dataset.

    A part counts once its folder holds the marker that Spark writes last, so a build that was
    cut off leaves nothing behind that readers see.
    """
    root = f"{path.rstrip('/')}/commits"
    schema = "record_id string, version string, label int, params string, n_windows long"
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    turns = [s.getPath().toString() for s in files.listStatus(place)] if files.exists(place) else []
    done = [t for t in turns if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{t}/_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], f"{schema}, turn string")
    return spark.read.schema(f"{schema}, turn string").option("basePath", root).parquet(*done)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last commit of each record."""
    columns = ("version", "label", "params", "n_windows", "turn")
    last = F.max_by(F.struct(*columns), "turn").alias("c")
    return commits(spark, path).groupBy("record_id").agg(last).select("record_id", "c.*")


def update_dataset(
    spark: SparkSession,
    samples: DataFrame,
    records: DataFrame,
    path: str,
    params: DatasetParams = DatasetParams(),
    encoder: embedding.Encoder = embedding.statistical_encoder,
    encoder_name: str = "statistical",
    is_mock: bool = True,
) -> int:
    """Build the rows of the records that are new or have changed; returns how many those are.

    ``records`` has ``record_id, version, label``; a record is built again when its version, its label
    or the parameters differ from its last commit. Nothing else of ``samples`` takes part, and
    without a change they are not read at all. Rows go to a folder of their own, and the commit that names
    it is written last: readers see all of a part or nothing, and a run that was cut off is
    repeated. Records that are no longer listed stay in the log but not in ``read_updated``.
    """
    key = params_key(params, encoder_name)
    wanted = records.select("record_id", F.col("version").cast("string"), F.col("label").cast("int"), F.lit(key).alias("params"))
    had = current(spark, path).select("record_id", "version", "label", "params")
    same = [wanted[c].eqNullSafe(had[c]) for c in ("record_id", "version", "label", "params")]
    changed = written(wanted.join(had, reduce(and_, same), "left_anti"))
    count = changed.count()
    if not count:
        return 0
    turn = f"{int(time.time() * 1e6):020d}-{uuid.uuid4().hex[:8]}"
    root = path.rstrip("/")
    part = samples.join(changed.select("record_id"), "record_id", "left_semi")
    rows = window_rows(part, changed.select("record_id", "label"), params, encoder, is_mock)
    rows.withColumn("failed", F.col("error").isNotNull().cast("int")).write.partitionBy("failed").parquet(f"{root}/parts/turn={turn}")
    made = spark.read.parquet(f"{root}/parts/turn={turn}").where("failed = 0").groupBy("record_id").agg(F.count(F.lit(1)).alias("n_windows"))
    log = changed.join(made, "record_id", "left").na.fill(0, ["n_windows"])
    log.select("record_id", "version", "label", "params", "n_windows").write.parquet(f"{root}/commits/turn={turn}")
    return count


def read_updated(spark: SparkSession, records: DataFrame, path: str) -> DataFrame:
    """The rows of each listed record's last commit. Fails with FileNotFoundError where nothing was committed."""
    last = current(spark, path).join(records.select("record_id"), "record_id", "left_semi").where("n_windows > 0")
    turns = [r["turn"] for r in last.select("turn").distinct().collect()]  # a row an update
    if not turns:
        raise FileNotFoundError(f"no dataset under {path}; build it first")
    root = f"{path.rstrip('/')}/parts"
    rows = spark.read.option("basePath", root).parquet(*[f"{root}/turn={t}" for t in turns]).where("failed = 0")
    rows = rows.withColumn("turn", F.col("turn").cast("string")).drop("failed", "error")
    return rows.join(last.select("record_id", "turn"), ["record_id", "turn"], "left_semi").drop("turn")
