"""Recording headers: text files with a record line, signal lines and ``#key value`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.functions import scalar

NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
# gain, optionally (baseline), optionally /units
GAIN = rf"^({NUMBER})(?:\((-?[0-9]+)\))?(?:/(\S+))?$"
# Header defaults when a field is absent or zero.
DEFAULT_GAIN = 200.0
DEFAULT_UNITS = "mV"

# Comment keys of the clinical metadata table and the column each one fills.
METADATA = {
    "pH": ("pH", "double"),
    "BDecf": ("BDecf", "double"),
    "pCO2": ("pCO2", "double"),
    "BE": ("BE", "double"),
    "Apgar1": ("Apgar1", "int"),
    "Apgar5": ("Apgar5", "int"),
    "Gest. weeks": ("gest_weeks", "int"),
    "Weight(g)": ("weight_g", "double"),
    "Sex": ("sex", "int"),
    "Age": ("maternal_age", "int"),
    "Gravidity": ("gravidity", "double"),
    "Parity": ("parity", "int"),
    "Diabetes": ("diabetes", "int"),
    "Hypertension": ("hypertension", "int"),
    "Preeclampsia": ("preeclampsia", "int"),
    "Meconium": ("meconium", "int"),
    "Presentation": ("presentation", "int"),
    "Induced": ("induced", "int"),
    "I.stage": ("stage1_min", "int"),
    "II.stage": ("stage2_min", "int"),
    "Deliv. type": ("delivery_type", "int"),
    "Pos. II.st.": ("pos_stage2", "int"),
}


def read_headers(spark: SparkSession, folder: str, pattern: str = "*.hea") -> DataFrame:
    """``record_id, content``: one row per header file, id from the file name.

    A missing folder fails in the reader; a folder without headers gives no rows. A header is a
    few dozen lines, so each file is one value.
    """
    files = spark.read.text(f"{folder.rstrip('/')}/{pattern}", wholetext=True)
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1)
    return files.select(name.alias("record_id"), F.col("value").alias("content"))


def list_records(headers: DataFrame) -> DataFrame:
    return headers.select("record_id").distinct().orderBy("record_id")


def first_records(headers: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` headers by id (0 or None: all); only the ids are ranked."""
    if not limit:
        return headers
    wanted = headers.select("record_id").distinct().orderBy("record_id").limit(limit)
    return headers.join(wanted, "record_id", "left_semi")


def _token(tokens: Column, at: int) -> Column:
    return F.get(tokens, F.lit(at))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each worked out once a row whatever reads it.

    Conditions on a generated column stay above it; on a projected one they move down to the
    table and repeat all the parsing that led to it, once for every place that names it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_headers(headers: DataFrame) -> DataFrame:
    """One row per header: record fields, ``signals`` array, ``comments`` map, ``error``.

    Lines are array elements of their row, so nothing is shuffled. ``error`` is NULL for usable
    records; callers split the rest off as quarantine.
    """
    lines = F.transform(F.split("content", r"\r?\n"), lambda l: F.trim(l))
    staged = _held(headers.select("record_id", "content"), _lines=lines).drop("content")
    staged = _held(staged, _data=F.filter("_lines", lambda l: (l != "") & ~l.startswith("#")))
    head = F.split(F.get("_data", F.lit(0)), r"\s+")

    def signal(t: Column, position: Column) -> Column:
        spec = F.coalesce(_token(t, 2), F.lit(""))
        gain = F.regexp_extract(spec, GAIN, 1).try_cast("double")
        units = F.regexp_extract(spec, GAIN, 3)
        zero = F.coalesce(F.regexp_extract(spec, GAIN, 2).try_cast("int"), _token(t, 4).try_cast("int"), F.lit(0))
        return F.struct(
            position.alias("position"),
            _token(t, 0).alias("file"),
            _token(t, 1).alias("format"),
            F.when(F.coalesce(gain, F.lit(0.0)) == 0, DEFAULT_GAIN).otherwise(gain).alias("gain"),
            zero.alias("baseline"),
            F.when(units == "", DEFAULT_UNITS).otherwise(units).alias("units"),
            _token(t, 3).try_cast("int").alias("resolution"),
            F.array_join(F.slice(t, 9, F.greatest(F.size(t) - 8, F.lit(0))), " ").alias("name"),
        )

    staged = _held(staged, _head=head)
    staged = _held(
        staged,
        n_signals=_token(F.col("_head"), 1).try_cast("int"),
        sampling_rate=F.regexp_extract(
            F.coalesce(_token(F.col("_head"), 2), F.lit("")), rf"^({NUMBER})", 1
        ).try_cast("double"),
        n_samples=_token(F.col("_head"), 3).try_cast("long"),
    )
    wanted = F.slice("_data", F.lit(2), F.greatest(F.coalesce("n_signals", F.lit(0)), F.lit(0)))
    tokens = F.transform(wanted, lambda l: F.split(l, r"\s+"))
    staged = _held(staged, signals=F.transform(tokens, signal))
    error = (
        F.when(F.col("n_signals").isNull() | F.col("n_samples").isNull(), "unreadable record line")
        .when(F.size("signals") != F.col("n_signals"), "missing signal lines")
        .when(channel("signals", "FHR").isNull(), "no FHR signal")
    )
    # Comments come last: whoever does not read them does not look for them either.
    pair = r"^#([^-].*?)\s+(\S+)$"
    marked = F.filter("_lines", lambda l: l.startswith("#"))
    pairs = F.transform(
        marked,
        lambda l: F.struct(
            F.trim(F.regexp_extract(l, pair, 1)).alias("key"), F.regexp_extract(l, pair, 2).alias("value")
        ),
    )
    # A line that is no pair has no value; the first line of a repeated key counts.
    staged = _held(staged, error=error).withColumn("_entries", F.filter(pairs, lambda c: c["value"] != ""))
    repeated = F.size(F.array_distinct(F.transform("_entries", lambda c: c["key"]))) < F.size("_entries")
    firsts = F.filter(
        "_entries", lambda e, k: ~F.exists(F.slice("_entries", F.lit(1), k), lambda o: o["key"] == e["key"])
    )
    comments = F.map_from_entries(F.when(repeated, firsts).otherwise(F.col("_entries")))
    return staged.withColumn("comments", comments).select(
        "record_id",
        "n_signals",
        "sampling_rate",
        "n_samples",
        (F.col("n_samples") / F.col("sampling_rate")).alias("duration_seconds"),
        "signals",
        "comments",
        "error",
    )


def channel(signals: str, target: str) -> Column:
    """The first signal whose upper-cased name contains ``target``; NULL if there is none."""
    return F.get(F.filter(signals, lambda s: F.contains(F.upper(s["name"]), F.lit(target.upper()))), F.lit(0))


def ph_values(headers: DataFrame) -> DataFrame:
    """``record_id, ph`` for every header; NULL where missing or unreadable.

    The first ``#pH`` line with a second token decides, even when that token is no number.
    """
    lines = F.transform(F.split("content", r"\r?\n"), lambda l: F.trim(l))
    tokens = F.transform(F.filter(lines, lambda l: l.startswith("#pH")), lambda l: F.split(l, r"\s+"))
    usable = F.filter(tokens, lambda t: F.size(t) >= 2)
    value = F.get(F.get(usable, F.lit(0)), F.lit(1)).try_cast("double")
    return headers.select("record_id", F.nanvl(value, F.lit(None).cast("double")).alias("ph"))


def outcome_labels(headers: DataFrame) -> DataFrame:
    return ph_values(headers).select("record_id", "ph", scalar.outcome_label(F.col("ph")).alias("label"))


def clinical_metadata(parsed: DataFrame) -> DataFrame:
    """31 typed columns per record; gains and true baselines come from the signal lines.

    What is absent, unreadable or not a number is NULL.
    """
    parsed = _held(parsed, _fhr=channel("signals", "FHR"), _uc=channel("signals", "UC"))
    fhr, uc = F.col("_fhr"), F.col("_uc")

    def typed_value(key: str, kind: str) -> Column:
        value = F.get(F.array(F.col("comments")[key]), F.lit(0)).try_cast(kind)
        return F.nanvl(value, F.lit(None).cast("double")) if kind == "double" else value

    typed = [typed_value(key, kind).alias(name) for key, (name, kind) in METADATA.items()]
    return parsed.select(
        "record_id",
        F.col("sampling_rate").alias("sampling_freq"),
        F.col("n_samples").alias("num_samples"),
        fhr.gain.alias("fhr_gain"),
        fhr.baseline.alias("fhr_baseline"),
        uc.gain.alias("uc_gain"),
        uc.baseline.alias("uc_baseline"),
        F.col("n_signals").alias("num_signals"),
        (F.col("duration_seconds") / 60).alias("duration_min"),
        *typed,
    )
