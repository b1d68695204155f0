"""Named queries over a folder of tables: one entry per operator family."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardiolake.functions import scalar
from cardiolake.operators import (
    alerts,
    contractions,
    decide,
    embedding,
    features,
    metrics,
    model,
    quality,
    series,
)
from cardiolake.operators.baseline import baseline, baseline_windows
from cardiolake.operators.clean import clean, clean_stats, gap_regions, in_range, interpolate, spikes
from cardiolake.operators.decelerations import (
    below_baseline_runs,
    decel_counts,
    decelerations,
    recurrent_count,
    recurrent_for_features,
    recurrent_share,
)
from cardiolake.operators.sinusoidal import sinusoidal
from cardiolake.operators.variability import variability, variability_windows
from cardiolake.operators.windows import prepare, window_bounds, window_samples, windows
from cardiolake.params import BaselineParams, SinusoidalParams, VariabilityParams, WindowParams
from cardiolake.plans import dataset, scoring, training
from cardiolake.operators.staging import shared_folder, stage
from cardiolake.sources import headers, signals
from cardiolake.sources.tables import samples_from_events, table
from cardiolake.streaming.windows import stream_windows

Query = Callable[[SparkSession, str], DataFrame]

# A window that fits the small tables as well as full recordings.
SHORT_WINDOWS = WindowParams(window_minutes=2.0, step_minutes=0.5)
SHORT_WAVE = SinusoidalParams(min_duration_minutes=5.0)


def six(column: str | Column) -> Column:
    return F.round(column, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums may differ in the last bits between engines."""
    return df.select(
        *[six(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# --- inputs derived from the tables -------------------------------------------------------


def heart(spark: SparkSession, folder: str) -> DataFrame:
    return clean(samples_from_events(spark, folder).select("record_id", "i", "fhr"), ("fhr",))


def heart_table(spark: SparkSession, folder: str) -> DataFrame:
    return stage(heart(spark, folder).select("record_id", "chunk", "i", "fhr"))


def both(spark: SparkSession, folder: str, uc_mode: str = "same") -> DataFrame:
    rules = scoring.RuleParams(uc_mode=uc_mode)
    return stage(scoring.clean_record_signals(samples_from_events(spark, folder), rules))


def order_findings(spark: SparkSession, folder: str) -> DataFrame:
    """One findings row per order, spread over every branch of the decision tables."""
    key = F.col("o_orderkey")
    customer = F.col("o_custkey")
    kinds = F.array(*[F.lit(k) for k in ("Absent", "Minimal", "Moderate", "Marked", "Unknown")])
    return table(spark, folder, "orders").select(
        key.alias("record_id"),
        (F.lit(95.0) + (customer % 17) * 5).alias("baseline"),
        F.element_at(kinds, ((key + customer) % 5 + 1).cast("int")).alias("variability_category"),
        (((key * 7) % 300) / 10).alias("variability_value"),
        (customer % 5).alias("late_count"),
        ((key + 1) % 6).alias("variable_count"),
        ((key % 3) * F.when((key + 1) % 6 > 0, 1).otherwise(0)).alias("severe_variable_count"),
        ((customer % 7 == 0).cast("long") * 2).alias("prolonged_count"),
        (customer % 3).alias("early_count"),
        (key % 4 == 0).alias("tachysystole"),
        (((key * 3) % 90) / 10).alias("contraction_rate"),
        ((key + customer) % 11 == 0).alias("sinusoidal"),
        (key % 3).cast("int").alias("ml_prediction"),
        ((customer % 101) / 100).alias("confidence"),
    ).withColumns(
        {
            "decel_count": F.expr("late_count + variable_count + prolonged_count + early_count"),
            "is_bradycardia": F.col("baseline") < 110,
        }
    )


def order_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Header texts written from orders, with missing, unreadable and repeated pH lines."""
    key = F.col("o_orderkey")
    cents = (F.col("o_custkey") * 37 + key) % 60
    ph = F.format_string("%d.%02d", F.lit(7), cents.cast("int"))
    ph_line = (
        F.when(key % 10 == 0, "# no outcome")
        .when(key % 10 == 1, "#pH           NaN")
        .when(key % 10 == 2, "#pH           n/a\n#pH           7.00")
        .when(key % 10 == 3, F.concat(F.lit("#pH\n#pH   "), ph))
        .otherwise(F.concat(F.lit("#pH           "), ph))
    )
    size = (F.lit(14400) + F.col("o_custkey") % 7221).cast("string")
    name = key.cast("string")
    head = F.when(key % 97 == 5, F.concat(name, F.lit(" two 4 "), size)).otherwise(
        F.concat(name, F.lit(" 2 4 "), size)
    )
    first = F.when(key % 89 == 7, "XHR").when(key % 2 == 0, "FHR").otherwise("fhr1")
    content = F.concat_ws(
        "\n",
        head,
        F.concat(name, F.lit(".dat 16 100(0)/bpm 12 0 15050 20101 0 "), first),
        F.concat(name, F.lit(".dat 16 50/nd 12 0 700 378 0 "), F.when(key % 3 == 0, "TOCO").otherwise("UC")),
        F.lit(""),
        F.concat(F.lit("#----- Additional parameters for record "), name),
        ph_line,
        *[F.concat(F.lit(f"#{name:<13}"), value) for name, value in _clinical_values(key, F.col("o_custkey")).items()],
    )
    # Two numbers move; the texts are written and parsed by all cores, also where a file is one part.
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey").repartition("o_orderkey", "o_custkey")
    return orders.select(name.alias("record_id"), content.alias("content"))


def _clinical_values(key: Column, customer: Column) -> dict[str, Column]:
    """Texts of the clinical header lines; a NULL leaves the line out, some values cannot be read."""
    tenths = lambda c: F.format_string("%.1f", c / 10)
    whole = {
        "Apgar1": customer % 11, "Apgar5": (customer + key) % 11, "Gest. weeks": F.lit(32) + key % 11, "Weight(g)": F.lit(1500) + customer % 3000,
        "Sex": F.lit(1) + key % 2, "Age": F.lit(18) + customer % 25, "Parity": customer % 5, "Diabetes": (key % 3 == 0).cast("int"),
        "Hypertension": key % 2, "Preeclampsia": (key % 7 == 0).cast("int"), "Meconium": customer % 2, "Presentation": F.lit(1) + customer % 3,
        "Induced": (key + customer) % 2, "I.stage": F.lit(30) + customer % 400, "II.stage": F.when(key % 5 > 0, key % 120),
        "Deliv. type": F.lit(1) + (key + 1) % 2, "Pos. II.st.": F.lit(12000) + customer % 7221,
    }
    return {
        "BDecf": tenths(customer % 130),
        "pCO2": F.when(key % 11 == 4, "NaN").otherwise(tenths(key % 90)),
        "BE": F.concat(F.lit("-"), tenths(customer % 140 + 1)),
        "Gravidity": F.when(key % 13 == 2, "n/a").otherwise((customer % 9).cast("string")),
        **{name: value.cast("string") for name, value in whole.items()},
    }


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Three-class labels and predictions per embedding row."""
    v, l = F.col("vec_id"), F.col("label")
    return table(spark, folder, "embeddings").select(
        (v % 7).cast("string").alias("record_id"),
        v.alias("w"),
        (l % 3).alias("label"),
        F.when(v % 4 == 0, (l + v) % 3).otherwise(l % 3).cast("int").alias("prediction"),
        F.col("embedding").alias("features"),
    )


def _scratch(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder."""
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    return f"{folder}/{uuid.uuid4().hex}"


# --- queries ------------------------------------------------------------------------------


def record_table(spark, folder):
    return signals.as_table(samples_from_events(spark, folder))


def record_lengths(spark, folder):
    n = F.count(F.lit(1))
    return samples_from_events(spark, folder).groupBy("record_id").agg(
        n.alias("n_samples"), (n / 4.0).alias("duration_seconds"), F.max(scalar.sample_time(F.col("i"))).alias("last_time")
    )


def range_rule(spark, folder):
    return samples_from_events(spark, folder).select("record_id", "i", in_range(F.col("fhr")).alias("fhr"))


def spike_flags(spark, folder):
    return spikes(samples_from_events(spark, folder).select("record_id", "i", "fhr")).select("record_id", "i", "spike")


def gap_runs(spark, folder):
    invalid = heart(spark, folder).withColumn("kept", F.when(~F.col("fhr_invalid"), F.col("fhr_raw")))
    return gap_regions(invalid.select("record_id", "i", "kept"), "kept")


def clean_signal(spark, folder):
    return rounded(heart(spark, folder).select("record_id", "i", "fhr", "fhr_invalid", "fhr_filled", "fhr_unfilled"))


def clean_smoothed(spark, folder):
    samples = samples_from_events(spark, folder).select("record_id", "i", "fhr")
    return rounded(clean(samples, ("fhr",), smoothing=True).select("record_id", "i", "fhr"))


def clean_statistics(spark, folder):
    return rounded(clean_stats(heart(spark, folder)))


def interpolate_linear(spark, folder):
    samples = samples_from_events(spark, folder).select("record_id", "i", in_range(F.col("fhr")).alias("fhr"))
    return rounded(interpolate(samples, "fhr").select("record_id", "i", "fhr", "fhr_was_missing"))


def interpolate_nearest(spark, folder):
    samples = samples_from_events(spark, folder).select("record_id", "i", in_range(F.col("fhr")).alias("fhr"))
    return rounded(interpolate(samples, "fhr", "nearest").select("record_id", "i", "fhr", "fhr_was_missing"))


def signal_summary(spark, folder):
    return rounded(quality.signal_summary(samples_from_events(spark, folder), "fhr"))


def safe_median(spark, folder):
    return rounded(quality.safe_median(samples_from_events(spark, folder), "fhr"))


def fill_with_mean(spark, folder):
    filled = quality.fill_missing(samples_from_events(spark, folder), "fhr", "mean")
    return rounded(filled.select("record_id", "i", "fhr"))


def signal_quality_profile(spark, folder):
    return rounded(quality.profile(samples_from_events(spark, folder)))


def sliding_window_bounds(spark, folder):
    return window_bounds(samples_from_events(spark, folder), SHORT_WINDOWS)


def stable_windows(spark, folder):
    found = baseline_windows(heart(spark, folder)).where("stable")
    return rounded(found.select("record_id", "start_idx", "range", "mean"))


def baseline_per_record(spark, folder):
    return rounded(baseline(heart(spark, folder)))


def rounding_and_classes(spark, folder):
    price = F.col("p_retailprice")
    value = scalar.nearest_5(price / 8)
    flags = scalar.baseline_flags(F.col("rounded"))
    spread = F.col("p_size") / 2.0
    return (
        table(spark, folder, "part")
        .select("p_partkey", value.alias("rounded"), spread.alias("spread"))
        .select("p_partkey", "rounded", *[c.alias(n) for n, c in flags.items()], scalar.variability_class(F.col("spread")).alias("variability"))
    )


def variability_window_values(spark, folder):
    found = variability_windows(heart(spark, folder)).where("start_idx is not null")
    return rounded(found)


def variability_quarter_overlap(spark, folder):
    return rounded(variability(heart(spark, folder), VariabilityParams(overlap_ratio=0.25)))


def baseline_seven_second_step(spark, folder):
    return rounded(baseline(heart(spark, folder), BaselineParams(step_seconds=7.0)))


def variability_per_record(spark, folder):
    return rounded(variability(heart(spark, folder)))


def runs_below_baseline(spark, folder):
    cleaned = heart_table(spark, folder)
    return below_baseline_runs(cleaned, baseline(cleaned)).select("record_id", "start_idx", "end_idx")


def _decelerations(spark, folder, uc_mode):
    cleaned = both(spark, folder, uc_mode)
    events = decelerations(cleaned, baseline(cleaned))
    return rounded(events.withColumn("severity_signs", F.concat_ws("; ", "severity_signs")))


def deceleration_events(spark, folder):
    return _decelerations(spark, folder, "same")


def deceleration_events_raw_uc(spark, folder):
    return _decelerations(spark, folder, "raw")


def deceleration_counts(spark, folder):
    cleaned = both(spark, folder)
    base = baseline(cleaned)
    return decel_counts(decelerations(cleaned, base), base)


def recurrence_rules(spark, folder):
    n = F.col("early_count")
    return order_findings(spark, folder).select(
        "record_id",
        recurrent_share(F.col("late_count"), n).alias("recurrent_share"),
        recurrent_for_features(F.col("decel_count"), n).alias("recurrent_for_features"),
        recurrent_count(F.col("late_count")).alias("recurrent_late"),
        recurrent_count(F.col("variable_count")).alias("recurrent_variable"),
    )


def tail_segments(spark, folder):
    placed = series.with_chunk(samples_from_events(spark, folder))
    last = series.tail(placed, 1200)
    return rounded(
        last.groupBy("record_id").agg(
            F.max("n").alias("n"), F.min("i").alias("first_idx"), F.count(F.lit(1)).alias("rows"),
            F.sum("uc").alias("uc_sum"), F.max("k").alias("last_k"),
        )
    )


def local_maxima(spark, folder):
    signal = heart(spark, folder).select("record_id", "i", F.coalesce("fhr", F.lit(0.0)).alias("u"))
    return rounded(contractions.local_maxima(contractions.changes(signal)))


def uc_upper_quartile(spark, folder):
    return rounded(series.percentiles(samples_from_events(spark, folder), "uc", 0.75, name="p75"))


def contraction_peaks(spark, folder):
    _, accepted = contractions.tail_contractions(both(spark, folder, "raw"))
    return rounded(accepted)


def spaced_heart_peaks(spark, folder):
    signal = heart(spark, folder).select("record_id", "i", F.coalesce("fhr", F.lit(0.0)).alias("u"))
    peaks = contractions.local_maxima(contractions.changes(signal))
    return rounded(contractions.spaced_long(peaks, 240))


def _tachysystole(spark, folder, uc_mode):
    found = contractions.tachysystole(both(spark, folder, uc_mode))
    return rounded(found.withColumn("contraction_indices", F.concat_ws(",", "contraction_indices")))


def tachysystole_per_record(spark, folder):
    return _tachysystole(spark, folder, "same")


def tachysystole_raw_uc(spark, folder):
    return _tachysystole(spark, folder, "raw")


def contraction_count(spark, folder):
    return contractions.contraction_count(both(spark, folder, "raw"))


def sinusoidal_default(spark, folder):
    return rounded(sinusoidal(heart_table(spark, folder)))


def sinusoidal_five_minutes(spark, folder):
    return rounded(sinusoidal(heart_table(spark, folder), SHORT_WAVE))


def rule_engine(spark, folder):
    rules = scoring.RuleParams(uc_mode="raw", sinusoidal=SHORT_WAVE)
    return rounded(scoring.rule_findings(both(spark, folder, "raw"), rules))


def rule_engine_per_window(spark, folder):
    """Rules inside each window: baseline and variability keyed by record and window."""
    inside = stage(
        window_samples(heart(spark, folder).select("record_id", "chunk", "i", "fhr"), SHORT_WINDOWS),
        by=("record_id", "w"),
        sort=("record_id", "w", "i"),
    )
    keys = ("record_id", "w")
    base = baseline(inside, BaselineParams(window_minutes=1.0), keys=keys)
    vary = variability(inside, keys=keys)
    events = decelerations(inside, base, keys=keys)
    counts = decel_counts(events, base, keys)
    return rounded(
        base.select(*keys, F.col("value").alias("baseline"), "stable_segment_found")
        .join(vary.select(*keys, F.col("value").alias("variability"), "category"), list(keys))
        .join(counts.select(*keys, "decel_count"), list(keys))
    )


def _window_rules(spark, folder, window, wave):
    rules = scoring.RuleParams(uc_mode="raw", sinusoidal=wave)
    return rounded(scoring.rule_findings_per_window(both(spark, folder, "raw"), window, rules))


def window_rules(spark, folder):
    """All five rules inside every 10-minute window, a window a minute."""
    return _window_rules(spark, folder, WindowParams(), SinusoidalParams())


def window_rules_with_spectrum(spark, folder):
    """All five rules inside 6-minute windows, long enough for the five-minute sinusoidal rule."""
    return _window_rules(spark, folder, WindowParams(window_minutes=6.0, step_minutes=2.0), SHORT_WAVE)


def prepared_windows(spark, folder):
    ready = prepare(windows(heart(spark, folder), SHORT_WINDOWS), SHORT_WINDOWS)
    return (
        ready.select(
            "record_id", "w", "start_idx", "end_idx",
            F.round("window_mean", 8).alias("window_mean"), F.round("window_std", 8).alias("window_std"),
            F.array_min("prepared").cast("double").alias("z_min"),
            F.array_max("prepared").cast("double").alias("z_max"),
            F.size("prepared").alias("width"),
        ).withColumns({"z_min": F.round("z_min", 3), "z_max": F.round("z_max", 3)})
    )


def _files_a_trigger(spark: SparkSession, path: str, triggers: int = 10) -> int:
    """Files that a stream takes at once: eight, or so many that ``triggers`` of them take all that lie there.

    A trigger reads and writes the state of every partition, so their number must not grow with the files.
    """
    return max(8, -(-len(spark.read.parquet(path).inputFiles()) // triggers))


def streamed_windows(spark, folder):
    """Windows of a stream of sample files, ten in turn and each with samples of the next: those of the batch plan."""
    path = _scratch(spark)
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i") / 4)
    samples = samples_from_events(spark, folder).select("record_id", "i", "fhr", start.alias("ts"))
    turn = F.expr("least(9, i div 2400 % 10 + if(i % 7 = 3, 1, 0))")
    ahead = (F.max("ts") + F.expr("interval 1 day")).alias("ts")
    last = samples.agg(ahead).selectExpr("'end' as record_id", "0L as i", "cast(null as double) as fhr", "ts")
    parted = samples.withColumn("turn", turn).persist()
    for k in range(10):  # files are taken by age
        parted.where(F.col("turn") == k).drop("turn").write.mode("append").parquet(f"{path}/in")
    last.write.mode("append").parquet(f"{path}/in")
    parted.unpersist()
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", _files_a_trigger(spark, f"{path}/in")).parquet(f"{path}/in")
    found = stream_windows(stream, SHORT_WINDOWS, delay_seconds=7200)
    out = found.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    out.start(f"{path}/out").awaitTermination()
    rows = spark.read.parquet(f"{path}/out").where("record_id <> 'end'")
    return rounded(rows.select("record_id", "w", "start_idx", "end_idx", "n_present", "sum_present"))


def window_embeddings(spark, folder):
    """One unit vector per window."""
    ready = prepare(windows(heart(spark, folder), SHORT_WINDOWS), SHORT_WINDOWS)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return embedding.embed(ready).select(
        "record_id", "w", "start_sec", "end_sec", F.size("embedding").alias("width"), F.round(norm, 3).alias("norm")
    )


def _load_weights(paths):
    """A tiny network: the largest value of a window times each weight."""
    import numpy as np

    weights = np.array([float(line) for line in open(paths[0])])
    return lambda prepared: prepared.max(axis=1, keepdims=True) * weights


def model_embeddings(spark, folder):
    """Windows encoded by a model that workers load from a shipped file of weights."""
    path = _scratch(spark)
    weights = table(spark, folder, "part").select(F.lit(1).alias("x")).limit(1).select(F.explode(F.expr("sequence(0, 1023)")).alias("k"))
    lines = weights.select(F.format_string("%d", F.expr("k div 512")).alias("value"), "k").coalesce(1).sortWithinPartitions("k")
    lines.select("value").write.text(path)
    file = spark.read.text(path).select(F.col("_metadata.file_path").alias("f")).first()["f"]
    encoder = embedding.ModelEncoder(spark, [file], _load_weights, batch_size=16)
    ready = prepare(windows(heart(spark, folder), SHORT_WINDOWS), SHORT_WINDOWS)
    found = embedding.embed(ready, encoder, is_mock=False)
    at = lambda k: F.round(F.col("embedding")[k].cast("double"), 3)
    return found.select("record_id", "w", F.size("embedding").alias("width"), at(511).alias("low"), at(512).alias("high"), "is_mock")


def rule_feature_columns(spark, folder):
    named = features.rule_features(F.col("early_count"))
    return rounded(order_findings(spark, folder).select("record_id", *[c.alias(n) for n, c in named.items()]))


def loose_rule_features(spark, folder):
    """Rule features of rows whose variability may be missing or zero."""
    named = features.rule_features(F.col("early_count"), loose=True)
    rows = order_findings(spark, folder).withColumn(
        "variability_value", F.when(F.col("record_id") % 5 > 0, F.col("variability_value"))
    )
    return rounded(rows.select("record_id", *[c.alias(n) for n, c in named.items()]))


def _labels(spark, folder):
    """A label per record from its name, known to both engines."""
    records = samples_from_events(spark, folder).select("record_id").distinct()
    return records.withColumn("label", (F.length("record_id") % 3).cast("int"))


def _feature_rows(spark, folder):
    return dataset.feature_rows(
        samples_from_events(spark, folder), _labels(spark, folder), dataset.DatasetParams(window=SHORT_WINDOWS)
    )


def feature_rows(spark, folder):
    """The 1,035-wide rows: window, label, width and whether every value is a number."""
    finite = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return _feature_rows(spark, folder).select(
        "record_id", "w", "start_idx", "end_idx", "label", F.size("features").alias("width"), finite.alias("finite")
    )


def feature_tail_per_window(spark, folder):
    """The eleven rule features as they end up in the 1,035-wide rows."""
    rows = _feature_rows(spark, folder)
    tail = features.rule_part(F.col("features"))
    return rows.select(
        "record_id", "w", "start_idx", "end_idx", "label", F.size("features").alias("width"),
        F.size(features.embedding_part(F.col("features"))).alias("embedding_width"),
        *[F.round(F.get(tail, F.lit(k)).cast("double"), 4).alias(n) for k, n in enumerate(features.RULE_FEATURES)],
    )


def dataset_roundtrip(spark, folder):
    """Features written to the shared folder and read back, counted by label."""
    path = _scratch(spark)
    dataset.write_dataset(_feature_rows(spark, folder), path)
    rows = dataset.read_dataset(spark, path)
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum(F.size("features")).alias("n_values"),
        F.max("end_idx").alias("last_idx"),
    )


def dataset_audit(spark, folder):
    """Windows and labels per label value; records without samples are reported as failed."""
    labels = _labels(spark, folder)
    missing = table(spark, folder, "events").select(F.concat("event_type", F.lit("-none")).alias("record_id")).distinct()
    labels = labels.unionByName(missing.withColumn("label", F.lit(0)))
    bounds = window_bounds(samples_from_events(spark, folder), SHORT_WINDOWS)
    rows = bounds.join(labels, "record_id")
    return dataset.audit_totals(dataset.audit(labels, rows))


def _falling_fails(prepared, seeds):
    """An encoder that cannot take a window whose first sample lies above the window's mean."""
    if (prepared[:, 0] > 0).any():
        raise ArithmeticError("window starts high")
    return embedding.statistical_encoder(prepared, seeds)


def _built(spark, folder):
    path = _scratch(spark)
    params = dataset.DatasetParams(window=SHORT_WINDOWS)
    return path, dataset.build_dataset(spark, samples_from_events(spark, folder), _labels(spark, folder), path, params, _falling_fails)


def dataset_build(spark, folder):
    """Totals of a dataset build whose encoder fails on some windows: only those are missing."""
    return _built(spark, folder)[1]


def window_quarantine(spark, folder):
    """The windows that the encoder failed on, each with its reason."""
    return dataset.read_quarantine(spark, _built(spark, folder)[0])


def dataset_update(spark, folder):
    """Rows after three builds into one dataset: all records, no change, and one record with a new version and label."""
    path, samples = _scratch(spark), samples_from_events(spark, folder)
    records = _labels(spark, folder).withColumn("version", F.lit("1"))
    params = dataset.DatasetParams(window=SHORT_WINDOWS)
    renewed = F.col("record_id") == "click-0"
    later = records.withColumns({"version": F.when(renewed, "2").otherwise("1"), "label": F.when(renewed, 2).otherwise(F.col("label"))})
    built = [dataset.update_dataset(spark, samples, r, path, params) for r in (records, records, later)]
    rows = dataset.read_updated(spark, later, path)
    return rows.select("record_id", "w", "start_idx", "end_idx", "label", *[F.lit(n).cast("long").alias(f"built_{k}") for k, n in enumerate(built)])


def feature_name_lookup(spark, folder):
    positions = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % features.FEATURE_COUNT).alias("position"))
    return features.feature_name_rows(positions)


def header_records(spark, folder):
    parsed = headers.parse_headers(order_headers(spark, folder)).where("error is null")
    fhr, uc = headers.channel("signals", "FHR"), headers.channel("signals", "UC")
    return rounded(
        parsed.select(
            "record_id", "n_signals", "sampling_rate", "n_samples", "duration_seconds",
            fhr.position.alias("fhr_position"), fhr.gain.alias("fhr_gain"), fhr.units.alias("fhr_units"),
            uc.position.alias("uc_position"), uc.gain.alias("uc_gain"),
        )
    )


def header_quarantine(spark, folder):
    return headers.parse_headers(order_headers(spark, folder)).where("error is not null").select("record_id", "error")


def header_outcomes(spark, folder):
    return headers.outcome_labels(order_headers(spark, folder))


def header_metadata(spark, folder):
    parsed = headers.parse_headers(order_headers(spark, folder)).where("error is null")
    return rounded(headers.clinical_metadata(parsed))


def first_records(spark, folder):
    return headers.list_records(headers.first_records(order_headers(spark, folder), 20))


def _blocks(spark, folder):
    """Samples as 16-bit codes, 4,096 frames a row."""
    code = F.coalesce(F.round(F.col("fhr") * 100).cast("int") - 10_000, F.lit(signals.MISSING_CODE))
    second = F.round(F.col("uc") * 50).cast("int")

    def two_bytes(c: Column) -> Column:
        unsigned = F.pmod(c, F.lit(65536))
        return F.format_string("%02X%02X", unsigned % 256, F.floor(unsigned / 256).cast("int"))

    return (
        samples_from_events(spark, folder)
        .withColumn("first", F.expr("i div 4096 * 4096"))
        .groupBy("record_id", "first")
        .agg(F.array_sort(F.collect_list(F.struct("i", F.concat(two_bytes(code), two_bytes(second)).alias("x")))).alias("b"))
        .select("record_id", F.unhex(F.array_join(F.transform("b", lambda s: s.x), "")).alias("content"), "first")
    )


def decode_signals(spark, folder):
    """Samples written as 16-bit codes in blocks and decoded again."""
    blocks = _blocks(spark, folder).select(
        "*",
        F.lit(2).alias("n_signals"),
        F.lit(0).alias("fhr_position"), F.lit(100.0).alias("fhr_gain"), F.lit(-10_000).alias("fhr_baseline"),
        F.lit(None).cast("int").alias("fhr2_position"), F.lit(None).cast("double").alias("fhr2_gain"), F.lit(None).cast("int").alias("fhr2_baseline"),
        F.lit(1).alias("uc_position"), F.lit(50.0).alias("uc_gain"), F.lit(0).alias("uc_baseline"),
    )
    return signals.decode_blocks(blocks).select("record_id", "i", F.round("fhr", 2).alias("fhr"), F.round("uc", 2).alias("uc"))


def _write_recording(batches):
    """Append each record's blocks, in order, to its signal file; rows are sorted by record."""
    from pyarrow import fs

    path, out = None, None
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.path != path:
                if out:
                    out.close()
                system, name = fs.FileSystem.from_uri(r.path)
                system.create_dir(name.rpartition("/")[0], recursive=True)
                path, out = r.path, system.open_output_stream(name)
            out.write(r.content)
        yield batch[["path"]].drop_duplicates()
    if out:
        out.close()


def _recordings(spark, folder):
    """A folder of recordings: every fifth record's file is cut short, absent, of another format, or split."""
    path = _scratch(spark)
    root = signals.qualified(spark, path)
    kind = F.expr("cast(split_part(record_id, '-', 2) as int) + length(split_part(record_id, '-', 1))") % 5
    blocks = _blocks(spark, folder).withColumn("kind", kind)
    size = blocks.groupBy("record_id", "kind").agg((F.sum(F.octet_length("content")) / 4).cast("long").alias("n"))
    second = F.when(F.col("kind") == 4, "other.dat").otherwise(F.concat("record_id", F.lit(".dat")))
    header = F.concat_ws(
        "\n",
        F.concat_ws(" ", "record_id", F.lit("2 4"), (F.col("n") + (F.col("kind") == 1).cast("int")).cast("string")),
        F.concat(F.col("record_id"), F.lit(".dat "), F.when(F.col("kind") == 3, "212").otherwise("16"), F.lit(" 100(-10000)/bpm 16 -10000 0 0 0 FHR")),
        F.concat(second, F.lit(" 16 50(0)/nd 16 0 0 0 0 UC")),
    )
    kept = blocks.where("kind <> 2").select(
        F.concat(F.lit(root + "/"), F.col("record_id"), F.lit(".dat")).alias("path"), "first", "content"
    )
    # One row a file comes back: the action writes the files.
    kept.repartition("path").sortWithinPartitions("path", "first").mapInPandas(_write_recording, "path string").count()
    return root, headers.parse_headers(size.select("record_id", header.alias("content")))


def ingested_samples(spark, folder):
    """Samples read back from signal files, of the records whose files hold what the header promises."""
    root, parsed = _recordings(spark, folder)
    broken = signals.signal_problems(parsed, root).select("record_id")
    found = signals.read_signals(signals.signal_splits(parsed.join(broken, "record_id", "left_anti"), root, 4096))
    return found.select("record_id", "i", F.round("fhr", 2).alias("fhr"), F.round("uc", 2).alias("uc"))


def ingest_quarantine(spark, folder):
    """Records whose signal files are cut short, absent, of another format, or several."""
    root, parsed = _recordings(spark, folder)
    return signals.signal_problems(parsed, root)



def class_weights(spark, folder):
    return rounded(metrics.class_weights(labelled(spark, folder)))


def weighted_rows(spark, folder):
    rows = metrics.with_weights(labelled(spark, folder))
    return rounded(rows.groupBy("record_id", "label").agg(F.sum("weight").alias("weight")))


def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(metrics.confusion(labelled(spark, folder)), [0, 1, 2])


def classification_report(spark, folder):
    return metrics.report(metrics.confusion(labelled(spark, folder)))


def macro_f1(spark, folder):
    return rounded(metrics.macro_f1(metrics.confusion(labelled(spark, folder))))


def label_quality_report(spark, folder):
    pairs = table(spark, folder, "labels").where("quality is not null and toxic is not null")
    return metrics.report(metrics.confusion(pairs, "quality", "toxic"))


def cv_summary(spark, folder):
    parts = labelled(spark, folder).groupBy("record_id").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score"))
    return rounded(metrics.cv_summary(parts))


def majority_vote(spark, folder):
    return decide.majority_vote(
        table(spark, folder, "lineitem").select(
            F.col("l_suppkey").alias("record_id"),
            (F.col("l_partkey") % 3).cast("int").alias("prediction"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("w"),
        )
    )


def mean_confidence(spark, folder):
    weights = [F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100 + 1]
    total = weights[0] + weights[1] + weights[2]
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("record_id"), F.array(*[w / total for w in weights]).alias("probability")
    )
    return rounded(metrics.mean_confidence(rows))


def stratified_folds(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    return metrics.stratified_folds(rows, 5, ["o_orderkey"]).select("o_orderkey", "label", "fold")


def grouped_folds(spark, folder):
    rows = labelled(spark, folder).select("record_id", "w")
    return metrics.grouped_folds(rows, 3).groupBy("record_id", "fold").agg(F.count(F.lit(1)).alias("n"))


def contiguous_labels(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", (F.col("label") % 4 * 10 + 5).alias("label"))
    return metrics.contiguous_labels(rows)


def category_lookup(spark, folder):
    key = (F.col("o_orderkey") % 5).cast("int")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        scalar.category_name(key).alias("name"),
        scalar.category_color(key).alias("color"),
        scalar.category_emoji(key).alias("emoji"),
        scalar.category_hex(key).alias("hex"),
    )


def rule_only_class(spark, folder):
    return order_findings(spark, folder).select("record_id", decide.rule_class().alias("rule_class"))


def safety_override(spark, folder):
    return decide.override(order_findings(spark, folder)).select(
        "record_id", "should_override", "final_category", "reason", "override_explanation", "category_name"
    )


def explained_alerts(spark, folder):
    return _alert_columns(scoring.decide_and_explain(order_findings(spark, folder)))


def _alert_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "record_id", "category", "confidence", "headline", "explanation",
        F.array_join("findings", " | ").alias("findings"),
        F.array_join("recommendations", " | ").alias("recommendations"),
        "color",
    )


def findings_summary(spark, folder):
    return order_findings(spark, folder).select(
        "record_id", *[c.alias(n) for n, c in alerts.findings_summary().items()]
    )


def deceleration_overlay(spark, folder):
    cleaned = both(spark, folder)
    return rounded(alerts.overlay(decelerations(cleaned, baseline(cleaned))))


def score_records(spark, folder):
    return rounded(_alert_columns(scoring.score(samples_from_events(spark, folder))))


def record_detail(spark, folder):
    return scoring.detail_card(scoring.rule_findings(both(spark, folder)))


def unprocessed_records(spark, folder):
    records = table(spark, folder, "part").select(F.col("p_partkey").alias("record_id"))
    results = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("record_id"))
    return quality.unprocessed(records, results)


# Classifiers trained in this process, by application and folder: several queries look at the same one.
_TRAINED: dict[tuple[str, str], model.TrainingResult] = {}


def _training_rows(spark, folder):
    return labelled(spark, folder).drop("prediction")


def _trained(spark, folder) -> model.TrainingResult:
    """The default classifier (100 rounds of depth 6) with its five folds, trained once a session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TRAINED:
        _TRAINED[key] = model.train(_training_rows(spark, folder))
    return _TRAINED[key]


def one_round_boosting(spark, folder):
    """One round of one split a class on line items: small enough to state every sum and share."""
    classes = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    line, discount, tax = (F.round(c).cast("int") for c in (F.col("l_linenumber"), F.col("l_discount") * 100, F.col("l_tax") * 100))
    rows = table(spark, folder, "lineitem").select(
        classes.alias("label"), line.alias("line"), discount.alias("discount"), tax.alias("tax"),
        F.array(*[c.cast("double") for c in (line, discount, tax)]).alias("features"),
    )
    params = model.ClassifierParams(n_estimators=1, max_depth=1, learning_rate=0.5, subsample=1.0, colsample=1.0)
    fitted = model.fit(metrics.with_weights(rows), params, key=("line", "discount", "tax"))[-1]
    kinds = rows.groupBy("line", "discount", "tax").agg(F.count(F.lit(1)).alias("n"), F.first("features").alias("features"))
    p = [F.round(F.col("probability")[k], 6).alias(f"p{k}") for k in range(3)]
    return model.predict(fitted, kinds).select("line", "discount", "tax", "n", *p)


def trained_predictions(spark, folder):
    """Every row with its label; predictions are known classes, probabilities shares of one."""
    rows = _training_rows(spark, folder)
    share = F.forall("probability", lambda p: (p >= 0) & (p <= 1))
    total = F.aggregate("probability", F.lit(0.0), lambda a, p: a + p)
    return model.predict(_trained(spark, folder).model, rows).select(
        "record_id", "w", F.col("label").cast("int").alias("label"),
        F.col("prediction").isin(0, 1, 2).alias("known_class"), share.alias("shares"), F.round(total, 6).alias("total"),
    )


def saved_model_predictions(spark, folder):
    """A model saved to the shared folder and loaded again predicts what the original predicts."""
    path, rows, params = _scratch(spark), _training_rows(spark, folder), model.ClassifierParams()
    fitted = _trained(spark, folder).model
    model.save(fitted, params, path, spark)
    again, stored = model.load(spark, path)
    first = model.predict(fitted, rows).select("w", F.col("prediction").alias("before"))
    both = model.predict(again, rows).select("record_id", "w", "prediction").join(first, "w")
    return both.select(
        "record_id", "w", (F.col("prediction") == F.col("before")).alias("same"), F.lit(stored == params).alias("same_params")
    )


def classifier_votes(spark, folder):
    """Votes equal the most frequent written prediction of each record, the first one on ties."""
    path, rows, fitted = _scratch(spark), _training_rows(spark, folder), _trained(spark, folder).model
    model.predict(fitted, rows).select("record_id", "w", "prediction").write.parquet(path)
    written = spark.read.parquet(path).groupBy("record_id", "prediction").agg(F.count("*").alias("n"), F.min("w").alias("w"))
    order = Window.partitionBy("record_id").orderBy(F.desc("n"), "w")
    top = written.withColumn("k", F.row_number().over(order)).where("k = 1").select("record_id", "prediction")
    return training.votes(fitted, rows).join(top, "record_id").select(
        "record_id",
        (F.col("ml_prediction") == F.col("prediction")).alias("is_majority"),
        F.col("confidence").between(1 / 3, 1).alias("is_share"),
    )


def cross_validated_training(spark, folder):
    """Three classes in five folds: scores are shares, the best one is at least their mean."""
    found = _trained(spark, folder)
    low, high = min(found.scores), max(found.scores)
    return found.summary.select(
        F.lit(len(found.scores)).alias("n_folds"),
        F.col("mean_score").between(low - 1e-9, high + 1e-9).alias("mean_inside"),
        F.col("best_score").between(0, 1).alias("best_is_share"),
    )


def feature_importances(spark, folder):
    """One share per feature; all of them make one."""
    rows = training.tables_of(_trained(spark, folder))["importance"]
    total = F.round(F.sum("importance").over(Window.partitionBy()), 6)  # one row per feature
    return rows.select("position", F.col("importance").between(0, 1).alias("is_share"), total.alias("total"))


def train_job(spark, folder):
    """The training job over a written dataset: sample count, fold scores and a model that loads."""
    data, path = _scratch(spark), _scratch(spark)
    rows = _training_rows(spark, folder)
    dataset.write_dataset(rows.withColumns({"start_idx": F.col("w"), "end_idx": F.col("w") + 1}), data)
    found = training.train_from(spark, data, path)
    fitted, _ = model.load(spark, path)
    return model.predict(fitted, rows).agg(F.count("*").alias("n_predicted")).select(
        F.lit(found["n_samples"]).cast("long").alias("n_samples"),
        F.lit(0 <= found["mean_cv_score"] <= found["best_score"] <= 1).alias("scores_are_shares"),
        "n_predicted",
    )


def score_with_votes(spark, folder):
    """Whole scoring with a classifier's votes: overrides and floors act on its class."""
    samples = samples_from_events(spark, folder)
    votes = samples.select("record_id").distinct().select(
        "record_id", (F.length("record_id") % 3).cast("int").alias("ml_prediction"), F.lit(0.5).alias("confidence")
    )
    return rounded(_alert_columns(scoring.score(samples, votes=votes)))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        record_table, record_lengths, range_rule, spike_flags, gap_runs, clean_signal, clean_smoothed,
        clean_statistics, interpolate_linear, interpolate_nearest, signal_summary, safe_median,
        fill_with_mean, signal_quality_profile, sliding_window_bounds, stable_windows,
        baseline_per_record, rounding_and_classes, variability_window_values, variability_per_record,
        variability_quarter_overlap, baseline_seven_second_step,
        runs_below_baseline, deceleration_events, deceleration_events_raw_uc, deceleration_counts,
        recurrence_rules, tail_segments, local_maxima, uc_upper_quartile, contraction_peaks,
        spaced_heart_peaks, tachysystole_per_record, tachysystole_raw_uc, contraction_count,
        sinusoidal_default, sinusoidal_five_minutes, rule_engine, rule_engine_per_window,
        window_rules, window_rules_with_spectrum,
        prepared_windows, streamed_windows, window_embeddings, model_embeddings, rule_feature_columns, loose_rule_features, feature_rows,
        feature_tail_per_window, dataset_roundtrip, dataset_audit, dataset_build, window_quarantine, dataset_update, feature_name_lookup, header_records,
        header_quarantine, header_outcomes, header_metadata, first_records, decode_signals,
        ingested_samples, ingest_quarantine,
        class_weights, weighted_rows, confusion_matrix, classification_report, macro_f1,
        label_quality_report, cv_summary, majority_vote, mean_confidence, stratified_folds,
        grouped_folds, contiguous_labels, category_lookup, rule_only_class, safety_override,
        explained_alerts, findings_summary, deceleration_overlay, score_records, record_detail,
        unprocessed_records, one_round_boosting, trained_predictions, saved_model_predictions, classifier_votes, cross_validated_training,
        feature_importances, train_job, score_with_votes,
    )
}
