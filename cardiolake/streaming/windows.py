"""Sliding windows of cleaned samples from a stream, equal to those of the batch plan."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cardiolake.params import CleanParams, WindowParams

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = "record_id string, w long, start_idx long, end_idx long, n_present long, sum_present double, values array<double>"
_STATE = "base long, w long, ready binary, ahead_i binary, ahead_x binary, latest long"


def clean_values(x: np.ndarray, params: CleanParams) -> np.ndarray:
    """Range, spike and gap rule over consecutive samples; NaN is missing."""
    with np.errstate(invalid="ignore"):
        out = np.where((x >= params.low) & (x <= params.high) & (x != 0), x, np.nan)
        spike = np.append(False, np.abs(np.diff(out)) > params.spike_threshold)
    out[spike] = np.nan
    missing = np.isnan(out)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], missing, [False]]).astype(np.int8)))
    for low, high in edges.reshape(-1, 2):
        if high - low > params.max_gap_samples or high - low == len(out):
            continue
        before = out[low - 1] if low else out[high]
        after = out[high] if high < len(out) else before
        out[low:high] = before + (after - before) / (high - low + 1) * np.arange(1, high - low + 1)
    return out


class Series:
    """What is kept of a record: the samples that open windows still need, and those that came too early."""

    def __init__(self, state: tuple | None):
        base, w, ready, ahead_i, ahead_x, latest = state or (0, 0, b"", b"", b"", 0)
        self.base, self.w, self.latest = base, w, latest
        self.ready = np.frombuffer(ready, np.float64)
        self.ahead = dict(zip(np.frombuffer(ahead_i, np.int64).tolist(), np.frombuffer(ahead_x, np.float64).tolist()))

    def state(self) -> tuple:
        i = np.array(sorted(self.ahead), np.int64)
        x = np.array([self.ahead[k] for k in i.tolist()], np.float64)
        return self.base, self.w, self.ready.tobytes(), i.tobytes(), x.tobytes(), self.latest

    def add(self, i: np.ndarray, x: np.ndarray) -> None:
        """Take samples in any order; the first value of a repeated one counts."""
        end = self.base + len(self.ready)
        for k, v in zip(i.tolist(), x.tolist()):
            if k >= end:
                self.ahead.setdefault(k, v)
        joined = []
        while end + len(joined) in self.ahead:
            joined.append(self.ahead.pop(end + len(joined)))
        self.ready = np.append(self.ready, joined)

    def close(self) -> None:
        """No more samples will come: those that never did are missing."""
        end = self.base + len(self.ready)
        if self.ahead:
            rest = np.full(max(self.ahead) + 1 - end, np.nan)
            for k, v in self.ahead.items():
                rest[k - end] = v
            self.ready, self.ahead = np.append(self.ready, rest), {}

    def windows(self, clean: CleanParams, window: WindowParams, closed: bool) -> Iterator[tuple]:
        """Windows that nothing can change any more; then what they alone needed is dropped.

        The cleaning rules look ``reach`` samples around: a gap that is filled, its anchors and the
        sample before them.
        """
        reach = clean.max_gap_samples + 2
        end = self.base + len(self.ready)
        while True:
            start = self.w * window.step
            stop = start + window.window
            if closed and self.w == 0 and end < stop:
                stop = end
            if stop > end - (0 if closed else reach) or stop == start:
                break
            low, high = max(start - reach, self.base), min(stop + reach, end)
            values = clean_values(self.ready[low - self.base : high - self.base], clean)[start - low : stop - low]
            present = ~np.isnan(values)
            found = [None if missing else v for v, missing in zip(values.tolist(), (~present).tolist())]
            total = float(values[present].sum()) if present.any() else None
            yield self.w, start, stop, int(present.sum()), total, found
            self.w += 1
            if stop == end and closed and end - start < window.window:
                break
        keep = max(self.base, min(self.w * window.step - reach, end))
        self.ready, self.base = self.ready[keep - self.base :], keep


def stream_windows(
    samples: DataFrame,
    window: WindowParams = WindowParams(),
    clean: CleanParams = CleanParams(),
    value: str = "fhr",
    delay_seconds: int = 60,
) -> DataFrame:
    """Whole windows of a stream of ``record_id, i, <value>, ts``, each as soon as it is final.

    Samples may come in any order and repeatedly. A record ends when the watermark has passed its last
    sample by ``delay_seconds``: the rest is cleaned as an end of series, a record shorter than a window
    gives one window, and samples that never came count as missing. A record keeps one window, the reach
    of the cleaning rules and the samples that came too early; later samples of an ended record
    start a series of their own.
    """
    delay = delay_seconds * 1000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series = Series(state.get if state.exists else None)
        closed = state.hasTimedOut
        for batch in batches:
            if batch.empty:  # an ended record comes without rows
                continue
            series.add(batch["i"].to_numpy(np.int64), batch["x"].to_numpy(np.float64))
            series.latest = max(series.latest, int(batch["at"].max()))
        if closed:
            series.close()
        rows = [(key[0], *row) for row in series.windows(clean, window, closed)]
        if closed:
            state.remove()
        else:
            state.update(series.state())
            state.setTimeoutTimestamp(max(series.latest + delay, state.getCurrentWatermarkMs() + 1))
        if rows:
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pd.DataFrame(rows, columns=names)

    marked = samples.withWatermark("ts", f"{delay_seconds} seconds").select(
        "record_id", F.col("i").cast("long").alias("i"), F.col(value).cast("double").alias("x"),
        F.unix_millis("ts").alias("at"), "ts",
    )
    return marked.groupBy("record_id").applyInPandasWithState(run, COLUMNS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
