"""Building blocks for long series keyed by ``(record, i)``.

A series is contiguous in ``i`` from 0. It is cut into chunks of ``size`` samples and every
windowed step is partitioned by ``(record, chunk)``, so one record that holds a large share of
all rows is still spread over many tasks. Steps that look at neighbours receive the rows near
the chunk edges as a halo; steps with unlimited reach carry one summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.params import CHUNK

KEYS = ("record_id",)

# Chunks summarised by one task when a carry or a stitch crosses chunk borders.
FAN = 65_536


def chunk_of(idx: str, size: int) -> Column:
    return F.expr(f"{idx} div {size}")


def with_chunk(df: DataFrame, size: int = CHUNK, idx: str = "i") -> DataFrame:
    return df.withColumn("chunk", chunk_of(idx, size))


def with_halo(
    df: DataFrame, before: int, after: int, size: int = CHUNK, idx: str = "i"
) -> DataFrame:
    """Add ``chunk`` so that chunk c holds ``[c*size - before, (c+1)*size + after)``.

    Only rows close to a chunk edge are copied: the growth is ``(before + after) / size``.
    """
    reach = F.expr(
        f"sequence(greatest({idx} - {after}, 0L) div {size}, ({idx} + {before}) div {size})"
    )
    return df.withColumn("chunk", F.explode(reach))


def core_rows(df: DataFrame, size: int = CHUNK, idx: str = "i") -> DataFrame:
    """Drop the halo copies again."""
    return df.where(chunk_of(idx, size) == F.col("chunk"))


def by_chunk(keys: Sequence[str] = KEYS, idx: str = "i"):
    return Window.partitionBy(*keys, "chunk").orderBy(idx)


def by_chunk_backwards(keys: Sequence[str] = KEYS, idx: str = "i"):
    return Window.partitionBy(*keys, "chunk").orderBy(F.col(idx).desc())


def carry(chunks: DataFrame, column: str, keys: Sequence[str], forward: bool) -> DataFrame:
    """Last non-null ``column`` of all earlier (or later) chunks, for one row per chunk.

    Two levels: inside blocks of ``FAN`` chunks, then over the block summaries.
    """
    sign = 1 if forward else -1
    out = f"{column}_carried"
    blocks = chunks.withColumn("_block", F.expr(f"chunk div {FAN}"))
    pick = F.max_by if forward else F.min_by
    totals = blocks.groupBy(*keys, "_block").agg(
        pick(F.col(column), F.when(F.col(column).isNotNull(), F.col("chunk"))).alias("_value")
    )
    outer = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_block") * sign)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.select(
        *keys, "_block", F.last("_value", True).over(outer).alias("_from_blocks")
    )
    inner = (
        Window.partitionBy(*keys, "_block")
        .orderBy(F.col("chunk") * sign)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        blocks.withColumn("_inside", F.last(column, True).over(inner))
        .join(totals, [*keys, "_block"])
        .withColumn(out, F.coalesce("_inside", "_from_blocks"))
        .drop("_block", "_inside", "_from_blocks")
        .hint("shuffle_hash")
    )


@dataclass(frozen=True)
class Piece:
    """An aggregate of a run that can be merged: how to start it and how to combine it."""

    name: str
    start: Column
    merge: str  # 'min', 'max' or 'sum'


def runs(
    flagged: DataFrame,
    pieces: Sequence[Piece] = (),
    keys: Sequence[str] = KEYS,
    size: int = CHUNK,
    idx: str = "i",
) -> DataFrame:
    """Contiguous runs ``[start_idx, end_idx)`` of rows that already passed the flag filter.

    Islands are found per chunk; runs that touch a chunk border are then joined, first inside
    blocks of ``FAN`` chunks and last over block borders. A run that touches no border is a group
    of its own (its cell is its start), however many a record has.
    """
    local = Window.partitionBy(*keys, "chunk").orderBy(idx)
    found = (
        flagged.withColumn("_island", F.col(idx) - F.row_number().over(local))
        .groupBy(*keys, "chunk", "_island")
        .agg(
            F.min(idx).alias("start_idx"),
            (F.max(idx) + 1).alias("end_idx"),
            *[p.start.alias(p.name) for p in pieces],
        )
        .drop("chunk", "_island")
    )
    merged = [
        F.min("start_idx").alias("start_idx"),
        F.max("end_idx").alias("end_idx"),
        *[getattr(F, p.merge)(p.name).alias(p.name) for p in pieces],
    ]
    for inner, outer in ((size, size * FAN), (size * FAN, None)):
        touching = F.expr(f"start_idx % {inner} = 0 or end_idx % {inner} = 0")
        shared = F.lit(0).cast("long") if outer is None else chunk_of("start_idx", outer)
        cell = F.when(touching, shared).otherwise(F.col("start_idx"))
        placed = found.withColumns({"_border": touching, "_cell": cell})
        w = Window.partitionBy(*keys, "_border", "_cell").orderBy("start_idx")
        fresh = F.coalesce(F.lag("end_idx").over(w) != F.col("start_idx"), F.lit(True))
        found = (
            placed.withColumn("_fresh", fresh.cast("int"))
            .withColumn("_run", F.sum("_fresh").over(w))
            .groupBy(*keys, "_border", "_cell", "_run")
            .agg(*merged)
            .drop("_border", "_cell", "_run")
        )
    return found


def common_step(step: int, window: int, size: int = CHUNK) -> int:
    """The largest block that divides step, window and chunk: what sliding windows are built from.

    Any step and window work; those with a large common divisor touch the fewest rows.
    """
    return gcd(step, window, size)


def step_buckets(
    df: DataFrame,
    step: int,
    value: str,
    keys: Sequence[str] = KEYS,
    size: int = CHUNK,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Aggregate blocks of ``step`` samples: the only rows sliding windows have to touch."""
    if size % step:
        raise ValueError(f"chunk size {size} must be a multiple of the step {step}")
    return (
        df.withColumn("bucket", F.expr(f"i div {step}"))
        .groupBy(*keys, "chunk", "bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(value).alias("n_valid"),
            F.sum(value).alias("total"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            *extra,
        )
        .drop("chunk")
    )


def bucket_frames(
    buckets: DataFrame,
    step: int,
    window: int,
    keys: Sequence[str] = KEYS,
    size: int = CHUNK,
):
    """Place buckets so that each chunk holds whole windows; returns (frame input, window spec).

    The frame of a bucket is the window that starts with it; rows with ``core = false`` only
    complete windows of the chunk before.
    """
    if window % step:
        raise ValueError(f"window {window} must be a multiple of the step {step}")
    per_chunk, span = size // step, window // step
    placed = with_halo(buckets, 0, span - 1, per_chunk, "bucket").withColumn(
        "core", chunk_of("bucket", per_chunk) == F.col("chunk")
    )
    frame = (
        Window.partitionBy(*keys, "chunk").orderBy("bucket").rowsBetween(0, span - 1)
    )
    return placed, frame


def window_frames(
    buckets: DataFrame, unit: int, window: int, step: int, keys: Sequence[str] = KEYS, size: int = CHUNK
):
    """(buckets with ``w`` and bounds, which rows start a window, its frame) for sliding windows of ``window`` samples.

    ``buckets`` hold ``n`` samples each. A series shorter than a window has one window over all of it.
    """
    if step % unit or window % unit:
        raise ValueError(f"window {window} and step {step} must be multiples of {unit}")
    placed, frame = bucket_frames(buckets, unit, window, keys, size)
    start, rows = F.col("bucket") * unit, F.sum("n").over(frame)
    placed = placed.withColumns(
        {"w": F.expr(f"bucket * {unit} div {step}"), "window_start": start, "window_end": start + rows}
    )
    length = F.col("window_end") - F.col("window_start")
    short = (F.col("bucket") == 0) & (length < window)
    whole = F.col("core") & (F.col("window_start") % step == 0) & ((length == window) | short)
    return placed, whole, frame


def tail(
    df: DataFrame, samples: int, keys: Sequence[str] = KEYS, size: int = CHUNK
) -> DataFrame:
    """Last ``samples`` rows of every series, with ``n`` and the tail-relative index ``k``.

    The series length is one row per record; it is expanded to the few chunks the tail touches
    and joined on ``(record, chunk)``, so no other chunk takes part and a long record stays split.
    """
    ends = df.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    ends = ends.withColumn("tail_start", F.greatest(F.col("n") - samples, F.lit(0).cast("long")))
    touched = ends.withColumn(
        "chunk", F.explode(F.expr(f"sequence(tail_start div {size}, (n - 1) div {size})"))
    ).hint("shuffle_hash")
    return (
        df.join(touched, [*keys, "chunk"])
        .where("i >= tail_start")
        .withColumn("k", F.col("i") - F.col("tail_start"))
        .drop("tail_start")
    )


def per_chunk(
    small: DataFrame, df: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Expand one row per record to one row per ``(record, chunk)`` of ``df``.

    Joining on both keys keeps the samples where the cleaning step put them and splits hot
    records. The result has one row per chunk, so each task hashes a handful of rows and the
    samples need no sort for the join.
    """
    return df.select(*keys, "chunk").distinct().join(small, list(keys)).hint("shuffle_hash")


def ranked(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, name: str = "rank"
) -> DataFrame:
    """``row_number()`` per key without sending a whole key to one task.

    ``bucket`` must be a bounded, monotone function of ``order`` (such as its leading hex
    digits): rows are numbered inside buckets and shifted by the sizes of the buckets before.
    """
    placed = df.withColumn("_bucket", bucket)
    sizes = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0).cast("long")).alias("_offset"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        placed.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_inside", "_offset")
    )


def _magnitude_cell(value: Column) -> Column:
    """A whole number that never falls while the value rises: its sign and its logarithm, 65,000 cells a side."""
    size = F.least(F.log(F.abs(value)) + 750.0, F.lit(1500.0))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.floor(F.signum(value) * size * 43))


def percentiles(
    df: DataFrame,
    value: str,
    quantile: float,
    keys: Sequence[str] = KEYS,
    name: str = "percentile",
) -> DataFrame:
    """Exact linear percentile per key for keys and value ranges of any size.

    Equal values are counted first. Then the one or two cells that hold the requested ranks are
    narrowed down for all keys at once: by sign and logarithm, and twice by parts of what a cell
    still spans, after which a cell holds a few thousand different doubles at most. Only those are looked at
    value by value.
    """
    v, at = F.col("_v"), F.col("_at")
    rows = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumns({"_group": F.lit(0).cast("long"), "_cell": _magnitude_cell(v).cast("long")})
    )
    for turn in range(3):
        cells = rows.groupBy(*keys, "_group", "_cell").agg(
            F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            *([F.max("_at").alias("_at")] if turn else []),
        )
        if not turn:
            cells = cells.withColumn("_at", (F.sum("_n").over(Window.partitionBy(*keys)) - 1) * F.lit(quantile))
        # A group is named by how many values come before it.
        upto = Window.partitionBy(*keys, "_group").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("_upto", F.col("_group") + F.sum("_n").over(upto)).withColumn("_skip", F.col("_upto") - F.col("_n"))
        cells = cells.where((F.col("_upto") > F.floor(at)) & (F.col("_skip") <= F.ceil(at)))
        held = cells.select(*keys, "_group", "_cell", "_skip", "_lo", "_hi", "_at")
        span = F.col("_hi") - F.col("_lo")
        part = F.when(span > 0, F.floor((v - F.col("_lo")) / span * 65_536)).otherwise(F.lit(0))
        rows = rows.drop("_at").join(held, [*keys, "_group", "_cell"]).select(
            *keys, "_v", "_c", "_at", F.col("_skip").alias("_group"), part.cast("long").alias("_cell")
        )
    inside = Window.partitionBy(*keys, "_group").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked_values = rows.withColumn("_last", F.col("_group") + F.sum("_c").over(inside)).withColumn(
        "_first", F.col("_last") - F.col("_c")
    )
    lower = F.when(F.expr("_first <= floor(_at) and _last > floor(_at)"), v)
    upper = F.when(F.expr("_first <= ceil(_at) and _last > ceil(_at)"), v)
    picked = ranked_values.groupBy(*keys).agg(
        F.max(lower).alias("_lo"), F.max(upper).alias("_hi"), F.max("_at").alias("_at")
    )
    return picked.select(
        *keys,
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.expr("_at - floor(_at)")).alias(name),
    )
