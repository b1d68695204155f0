"""Contraction peaks and their rate."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardiolake.functions.scalar import half_even
from cardiolake.operators import series
from cardiolake.operators.spacing import spaced_cells
from cardiolake.operators.staging import stage
from cardiolake.params import CHUNK, TachysystoleParams

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def changes(
    signal: DataFrame,
    value: str = "u",
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
    idx: str = "i",
) -> DataFrame:
    """Rows where the value differs from the one before, with ``rise`` and the next change.

    Runs of equal values collapse to their first row, so plateaus of any length need no group.
    The next change may lie many chunks ahead; it comes from one carried row per chunk.
    """
    if "chunk" not in signal.columns:
        signal = series.with_chunk(signal, size, idx)
    signal = signal.select(*keys, "chunk", idx, value)
    # The value before a chunk is the last one of the chunk before: one row per chunk.
    edges = signal.groupBy(*keys, "chunk").agg(F.max_by(value, idx).alias("_edge"))
    edges = edges.withColumn("chunk", F.col("chunk") + 1).hint("shuffle_hash")
    order = series.by_chunk(keys, idx)
    stepped = (
        signal.join(edges, [*keys, "chunk"], "left")
        .withColumn("_before", F.coalesce(F.lag(value).over(order), "_edge"))
        .where(F.col(value) != F.col("_before"))
        .withColumn("rise", F.col(value) > F.col("_before"))
        .withColumn("_self", F.struct(F.col(idx).alias("i"), "rise"))
        .withColumn("_next", F.lead("_self").over(order))
    )
    firsts = stepped.groupBy(*keys, "chunk").agg(F.min("_self").alias("_first"))
    firsts = series.carry(firsts, "_first", keys, False).drop("_first")
    joined = stepped.join(firsts, [*keys, "chunk"]).withColumn(
        "_next", F.coalesce("_next", "_first_carried")
    )
    return joined.select(
        *keys,
        F.col(idx).alias("i"),
        F.col(value).alias("u"),
        "rise",
        F.col("_next.i").alias("next_i"),
        F.col("_next.rise").alias("next_rise"),
    )


def local_maxima(stepped: DataFrame, keys: Sequence[str] = series.KEYS) -> DataFrame:
    """Peaks ``p, h``: a rise followed by a fall; a plateau counts once, at its middle.

    The first and last run of a series have a neighbour on one side only and never count.
    """
    return stepped.where(F.col("rise") & ~F.col("next_rise")).select(
        *keys, F.expr("(i + next_i - 1) div 2").alias("p"), F.col("u").alias("h")
    )


def turning_points(stepped: DataFrame, keys: Sequence[str] = series.KEYS) -> DataFrame:
    """Rows that end a monotone stretch: all that minima between peaks depend on."""
    turns = F.col("next_rise").isNull() | (F.col("rise") != F.col("next_rise"))
    return stepped.where(turns).select(*keys, "i", "u")


def spaced(peaks: DataFrame, distance: int, keys: Sequence[str]) -> DataFrame:
    """Keep peaks at least ``distance`` apart: highest first, the later one on ties.

    ``keys`` must name bounded groups (a tail, or a session of close peaks).
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("h")).alias("o"), (-F.col("p")).alias("q"))))
    grouped = peaks.groupBy(*keys).agg(ordered.alias("_ordered"))

    def keep(kept: Column, peak: Column) -> Column:
        close = F.exists(kept, lambda k: F.abs(k.q - peak.q) < distance)
        return F.when(close, kept).otherwise(F.concat(kept, F.array(peak)))

    empty = F.slice("_ordered", 1, 0)
    survivors = grouped.withColumn("_kept", F.aggregate("_ordered", empty, keep))
    return survivors.select(*keys, F.explode("_kept").alias("_k")).select(
        *keys, (-F.col("_k.q")).alias("p"), (-F.col("_k.o")).alias("h")
    )


def prominences(
    peaks: DataFrame, points: DataFrame, keys: Sequence[str] = series.KEYS
) -> DataFrame:
    """Prominence of each peak inside a bounded series.

    ``points`` are the turning points including both series ends. The base on each side is the
    minimum up to the nearest strictly higher point.
    """
    i, p, h = F.col("i"), F.col("p"), F.col("h")
    around = peaks.join(points, list(keys))
    higher = F.col("u") > h
    bounds = around.groupBy(*keys, "p", "h").agg(
        F.coalesce(F.max(F.when(higher & (i < p), i)), F.lit(-1)).alias("_lb"),
        F.min(F.when(higher & (i > p), i)).alias("_rb"),
    )
    inside = bounds.join(points, list(keys)).where(
        (i > F.col("_lb")) & (F.col("_rb").isNull() | (i < F.col("_rb")))
    )
    bases = inside.groupBy(*keys, "p", "h").agg(
        F.least(F.min(F.when(i < p, F.col("u"))), h).alias("left_base"),
        F.least(F.min(F.when(i > p, F.col("u"))), h).alias("right_base"),
    )
    return bases.withColumn("prominence", h - F.greatest("left_base", "right_base"))


def tail_marks(
    samples: DataFrame,
    params: TachysystoleParams = TachysystoleParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """The rows of each record's tail that peaks depend on, from one pass over the tail.

    Kept are both ends and every change of value, with ``rise``, the next change and the
    record's signal figures. No group is longer than the window, whatever the record length.
    """
    if "chunk" not in samples.columns:
        samples = series.with_chunk(samples, size)
    last = series.tail(samples.select(*keys, "chunk", "i", "uc"), params.window, keys, size)
    last = last.select(*keys, "n", F.col("k").alias("i"), F.coalesce("uc", F.lit(0.0)).alias("u"))
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("i")
    u, i = F.col("u"), F.col("i")
    marked = last.withColumns(
        {
            "_before": F.lag("u").over(order),
            "deviation": F.stddev_pop("u").over(whole),
            "floor_height": F.percentile("u", F.lit(0.75)).over(whole),
            "largest": F.max(F.abs("u")).over(whole),
            "_last": F.max("i").over(whole),
        }
    )
    changed = u != F.col("_before")
    marked = marked.where((i == 0) | (i == F.col("_last")) | changed).withColumns(
        {"changed": F.coalesce(changed, F.lit(False)), "rise": u > F.col("_before")}
    )
    following = F.struct("i", "rise")
    backwards = whole.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.withColumn("_next", F.last(F.when(F.col("changed"), following), True).over(backwards))
        .withColumns({"next_i": F.col("_next.i"), "next_rise": F.col("_next.rise")})
        .drop("_before", "_next")
    )


def tail_contractions(
    samples: DataFrame,
    params: TachysystoleParams = TachysystoleParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """(signal figures per record, accepted peaks) of the last ``window`` samples.

    The marks are few and read several times, so they are written once.
    """
    marks = stage(tail_marks(samples, params, keys, size), list(keys), [*keys, "i"])
    figures = marks.where("i = 0").select(
        *keys, "n", "deviation", "floor_height", "largest"
    )
    active = marks.where((F.col("largest") > 0) & (F.col("deviation") >= 1e-6))
    ends = (F.col("i") == 0) | (F.col("i") == F.col("_last"))
    turns = F.col("changed") & (F.col("next_rise").isNull() | (F.col("rise") != F.col("next_rise")))
    points = active.where(ends | turns).select(*keys, "i", "u")
    stepped = active.where("changed and u >= floor_height")
    found = prominences(spaced(local_maxima(stepped, keys), params.distance, keys), points, keys)
    accepted = (
        found.join(figures.select(*keys, "deviation"), list(keys))
        .where(F.col("prominence") >= F.col("deviation") * 0.5)
        .select(*keys, "p", "h", "prominence")
    )
    return figures, accepted


def tachysystole(
    samples: DataFrame,
    params: TachysystoleParams = TachysystoleParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """Contraction rate of the tail, one row per record; indices are relative to the tail."""
    figures, accepted = tail_contractions(samples, params, keys, size)
    listed = accepted.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("contraction_indices"))
    return rate_row(figures.join(listed, list(keys), "left"), params, keys)


def rate_row(
    df: DataFrame, params: TachysystoleParams, keys: Sequence[str] = series.KEYS
) -> DataFrame:
    flat = (F.col("largest") == 0) | (F.col("deviation") < 1e-6)
    minutes = F.when(
        F.col("n") < params.window, F.col("n") / F.lit(params.sampling_rate) / 60
    ).otherwise(F.lit(float(params.window_minutes)))
    total = F.coalesce(F.size("contraction_indices"), F.lit(0))
    nothing = F.array().cast("array<bigint>")
    return (
        df.withColumn("contraction_indices", F.coalesce("contraction_indices", nothing))
        .withColumns({"_minutes": minutes, "total_contractions": total})
        .withColumn("_rate", F.col("total_contractions") / (F.col("_minutes") / 10.0))
        .select(
            *keys,
            (~flat & (F.col("_rate") > params.threshold_per_10min)).alias("detected"),
            F.when(flat, 0.0).otherwise(half_even(F.col("_rate"), 1)).alias("contractions_per_10min"),
            "total_contractions",
            F.when(flat, F.col("_minutes"))
            .otherwise(half_even(F.col("_minutes"), 1))
            .alias("analysis_duration_minutes"),
            "contraction_indices",
            F.when(flat, 0.0)
            .otherwise(half_even(F.least(F.lit(1.0), F.col("deviation") / 20), 2))
            .alias("confidence"),
        )
    )


def spaced_long(
    peaks: DataFrame, distance: int, keys: Sequence[str] = series.KEYS, size: int = CHUNK
) -> DataFrame:
    """``spaced`` for series of any length.

    A peak that is the best within ``distance`` is kept and its neighbours go, whatever happens
    elsewhere. What is left open (rising and level stretches, valleys) cannot meet the kept ones any
    more and is settled cell by cell.
    """
    reach = distance - 1
    placed = series.with_halo(peaks.select(*keys, "p", "h"), 2 * reach, 2 * reach, size, "p")
    around = Window.partitionBy(*keys, "chunk").orderBy("p").rangeBetween(-reach, reach)
    judged = (
        placed.withColumn("_best", F.max(F.struct("h", "p")).over(around).p == F.col("p"))
        .withColumn("_open", ~F.max("_best").over(around))
    )
    judged = series.core_rows(judged, size, "p").where("_best or _open")
    # Read twice; the open ones are cut anew.
    judged = stage(judged.select(*keys, "chunk", "p", "h", "_best"), [*keys, "chunk"], [*keys, "chunk", "p"])
    kept = judged.where("_best").select(*keys, "p", "h")
    return kept.union(spaced_cells(judged.where("not _best").select(*keys, "p", "h"), distance, keys, size))


def prominences_long(
    peaks: DataFrame, points: DataFrame, keys: Sequence[str] = series.KEYS, size: int = CHUNK
) -> DataFrame:
    """``prominences`` for series of any length.

    Each chunk finds the bases that lie inside it. Where no point of the chunk is higher than a
    peak, one (low, high) row per chunk tells the nearest chunk with a higher point and the minimum
    on the way, once per chunk, side and height; that chunk then adds the minimum of its own near
    end, again once per height. So level peaks cost one look per chunk, and no peak meets the chunks
    or the points of a whole series.
    """
    if "chunk" not in points.columns:
        points = points.withColumn("chunk", series.chunk_of("i", size))
    place = [*keys, "chunk"]
    # New column identities: peaks come from the same table, and cogroups need to tell both sides apart.
    points = points.select(*[F.col(c).alias(c) for c in (*place, "i", "u")])
    homes = peaks.select(*keys, series.chunk_of("p", size).alias("chunk"), "p", "h")
    types = {f.name: f for f in [*points.schema, *homes.schema]}

    def schema_of(*names: str, **more: T.DataType) -> T.StructType:
        return T.StructType([*[types[n] for n in names], *[T.StructField(n, t) for n, t in more.items()]])

    number, flag, index = T.DoubleType(), T.BooleanType(), T.LongType()

    def inside(own: pa.Table, all_: pa.Table) -> pa.Table:
        order = np.argsort(all_["i"].to_numpy())
        i, u = all_["i"].to_numpy()[order], all_["u"].to_numpy()[order]
        found = {"left": [], "right": [], "left_open": [], "right_open": []}
        for p, h in zip(own["p"].to_numpy(), own["h"].to_numpy()):
            a, b = np.searchsorted(i, p, side="left"), np.searchsorted(i, p, side="right")
            for side, part in (("left", u[:a][::-1]), ("right", u[b:])):
                higher = part > h
                at = int(higher.argmax()) if higher.any() else len(part)
                found[side].append(min(part[:at].min(initial=np.inf), h))
                found[f"{side}_open"].append(at == len(part))
        for name, values in found.items():
            own = own.append_column(name, pa.array(values, pa.bool_() if name.endswith("open") else pa.float64()))
        return own

    near = (
        homes.groupBy(*place)
        .cogroup(points.groupBy(*place))
        .applyInArrow(inside, schema_of(*place, "p", "h", left=number, right=number, left_open=flag, right_open=flag))
    )
    near = stage(near, place, [*place, "p"])
    # One row per chunk, height and open side.
    asked = near.select(*place, "h", F.explode(F.array_compact(F.array(
        F.when(F.col("left_open"), F.lit(True)), F.when(F.col("right_open"), F.lit(False))
    ))).alias("to_left")).distinct()
    extents = points.groupBy(*place).agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    extents = extents.select(*[F.col(c).alias(c) for c in extents.columns])

    def over_chunks(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        order = np.argsort(chunks["chunk"].to_numpy())
        c, lo, hi = (chunks[n].to_numpy()[order] for n in ("chunk", "lo", "hi"))
        home, height = queries["chunk"].to_numpy(), queries["h"].to_numpy()
        left = queries["to_left"].to_numpy(zero_copy_only=False)
        stop, base = np.full(len(home), -1, np.int64), np.full(len(home), np.inf)
        found, base[left] = nearest_higher(c, lo, hi, home[left], height[left])
        stop[left] = np.where(found >= 0, c[np.maximum(found, 0)], -1)
        found, base[~left] = nearest_higher(-c[::-1], lo[::-1], hi[::-1], -home[~left], height[~left])
        stop[~left] = np.where(found >= 0, c[::-1][np.maximum(found, 0)], -1)
        return queries.append_column("stop", pa.array(stop, mask=stop < 0)).append_column("base", pa.array(base))

    beyond = (
        asked.groupBy(*keys)
        .cogroup(extents.groupBy(*keys))
        .applyInArrow(over_chunks, schema_of(*place, "h", to_left=flag, stop=index, base=number))
    )
    stops = beyond.where("stop is not null").select(*keys, F.col("stop").alias("chunk"), "h", "to_left").distinct()

    def at_stop(queries: pa.Table, all_: pa.Table) -> pa.Table:
        order = np.argsort(all_["i"].to_numpy())
        u = all_["u"].to_numpy()[order]
        bases = []
        for h, to_left in zip(queries["h"].to_pylist(), queries["to_left"].to_pylist()):
            part = u[::-1] if to_left else u  # from the peak's side on
            bases.append(part[: int((part > h).argmax())].min(initial=np.inf))
        return queries.append_column("edge", pa.array(bases, pa.float64()))

    edges = (
        stops.groupBy(*place)
        .cogroup(points.groupBy(*place))
        .applyInArrow(at_stop, schema_of(*place, "h", to_left=flag, edge=number))
        .withColumnRenamed("chunk", "stop")
    )
    far = beyond.join(edges, [*keys, "stop", "h", "to_left"], "left").groupBy(*place, "h").agg(
        F.min(F.when(F.col("to_left"), F.least("base", "edge"))).alias("far_left"),
        F.min(F.when(~F.col("to_left"), F.least("base", "edge"))).alias("far_right"),
    )
    h = F.col("h")
    joined = near.join(far, [*place, "h"], "left")
    left = F.least("left", F.when(F.col("left_open"), F.col("far_left")))
    right = F.least("right", F.when(F.col("right_open"), F.col("far_right")))
    return joined.select(*keys, "p", "h", (h - F.greatest(left, right)).alias("prominence"))


def nearest_higher(
    chunks: np.ndarray, lows: np.ndarray, highs: np.ndarray, home: np.ndarray, height: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``chunks`` of the nearest one before ``home`` whose high is above ``height`` (-1: none).

    With it comes the least low of the chunks between. Chunks ascend; extents of 1, 2, 4, ... chunks
    let all queries step back together in a logarithm of their number.
    """
    tops, bottoms = [highs], [lows]
    while len(tops[-1]) > (half := 1 << (len(tops) - 1)):
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
        bottoms.append(np.minimum(bottoms[-1][:-half], bottoms[-1][half:]))
    at = np.searchsorted(chunks, home, side="left")
    base = np.full(len(home), np.inf)
    for level in reversed(range(len(tops))):
        back = at - (1 << level)
        jump = back >= 0
        jump[jump] = tops[level][back[jump]] <= height[jump]
        base[jump] = np.minimum(base[jump], bottoms[level][back[jump]])
        at = np.where(jump, back, at)
    return at - 1, base


def contraction_count(
    samples: DataFrame,
    params: TachysystoleParams = TachysystoleParams(),
    keys: Sequence[str] = series.KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """Contractions over whole series of any length: ``total_contractions`` per record.

    Turning points, spaced peaks and the figures per chunk are read several times, so each is
    written once.
    """
    if "chunk" not in samples.columns:
        samples = series.with_chunk(samples, size)
    fs = F.lit(params.sampling_rate)
    lengths = samples.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    # The length passes through minutes and back, which can lose the first sample.
    kept = F.floor(F.col("n") / fs / 60 * 60 * fs)
    lengths = lengths.withColumn("_from", F.col("n") - kept)
    signal = (
        samples.select(*keys, "chunk", "i", F.coalesce("uc", F.lit(0.0)).alias("u"))
        .join(series.per_chunk(lengths, samples, keys), [*keys, "chunk"])
        .where("i >= _from")
    )
    figures = (
        signal.groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.max("_from").alias("_from"),
            F.stddev_pop("u").alias("deviation"),
            F.max(F.abs("u")).alias("largest"),
        )
        .where("largest > 0 and deviation >= 1e-6")
        .join(series.percentiles(signal, "u", 0.75, keys, name="floor_height"), list(keys))
    )
    place = [*keys, "chunk"]
    chunk_figures = stage(series.per_chunk(figures, samples, keys), place, place).hint("shuffle_hash")

    def with_figures(df: DataFrame, at: str, *columns: str) -> DataFrame:
        placed = df.withColumn("chunk", series.chunk_of(at, size))
        return placed.join(chunk_figures.select(*place, *columns), place)

    stepped = changes(signal.select(*place, "i", "u"), "u", keys, size)
    turns = stepped.where(F.col("next_rise").isNull() | (F.col("rise") != F.col("next_rise")))
    ends = (
        signal.select(*place, "i", "u")
        .join(chunk_figures.select(*place, F.col("_from").alias("_first"), F.col("n").alias("_n")), place)
        .where("i = _first or i = _n - 1")
    )
    marks = turns.select(*keys, "i", "u", "rise", "next_i", "next_rise").unionByName(
        ends.select(*keys, "i", "u"), allowMissingColumns=True
    )
    marks = stage(marks.withColumn("chunk", series.chunk_of("i", size)), place, [*place, "i"])
    points = marks.select(*place, "i", "u")
    peaks = with_figures(local_maxima(marks, keys), "p", "floor_height").where("h >= floor_height")
    apart = spaced_long(peaks, params.distance, keys, size)
    found = with_figures(prominences_long(apart, points, keys, size), "p", "deviation")
    counted = (
        found.where(F.col("prominence") >= F.col("deviation") * 0.5)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("total_contractions"))
    )
    return lengths.select(*keys).join(counted, list(keys), "left").na.fill(0, ["total_contractions"])
