"""Minimum distance between peaks, highest first, for series of any length in groups of bounded size.

A peak stays unless a higher peak that stays (the later one on ties) lies closer than the distance. What
stays in one cell of a series depends on its neighbours through two peaks only: the last one that
stays before its border and the first one after it. So each cell answers what it would keep at its own
borders for every such pair, the answers of a record are chained, one row a cell, and each cell
then settles with its two neighbours known.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardiolake.operators import series
from cardiolake.params import CHUNK

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NONE = -1  # no peak stays within the distance of the border
_AT_ONCE = 512  # pairs of neighbours that a cell answers together


def kept_given(
    p: np.ndarray, h: np.ndarray, distance: int, before: np.ndarray, after: np.ndarray, before_h: np.ndarray, after_h: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(peak, case) matrix of what stays, and which cases can be, for pairs of staying neighbours.

    A case cannot be if a peak gives way to a neighbour only and ranks above it: then that neighbour
    would not stay.
    """
    low = np.searchsorted(p, p - distance, side="right")
    high = np.searchsorted(p, p + distance, side="left")
    taken = np.zeros((len(p), len(before)), bool)
    possible = np.ones(len(before), bool)
    kept = np.zeros((len(p), len(before)), bool)
    for k in np.lexsort((p, h))[::-1].tolist():
        left = (before != NONE) & (p[k] - before < distance)
        right = (after != NONE) & (after - p[k] < distance)
        open_ = ~taken[k]
        free = open_ & ~left & ~right
        lower_left = left & (before_h < h[k])  # an equal neighbour before ranks below as well
        lower_left |= left & (before_h == h[k])
        lower_right = right & (after_h < h[k])
        above = (left & ~lower_left) | (right & ~lower_right)
        possible &= free | ~open_ | above
        kept[k] = free
        if free.any():
            taken[low[k] : high[k]] |= free
    return kept, possible


class Cell:
    """The open peaks of one cell and those of its neighbours that lie within the distance."""

    def __init__(self, group: pa.Table, span: int, distance: int):
        group = group.sort_by("p")
        p, h = group["p"].to_numpy(), group["h"].to_numpy()
        self.number = group["chunk"][0].as_py()
        self.low, self.high, self.distance = self.number * span, (self.number + 1) * span, distance
        own = (p >= self.low) & (p < self.high)
        self.table, self.p, self.h = group.filter(pa.array(own)), p[own], h[own]
        self.before, self.before_h = np.append(NONE, p[p < self.low]), np.append(0.0, h[p < self.low])
        self.after, self.after_h = np.append(NONE, p[p >= self.high]), np.append(0.0, h[p >= self.high])

    def _run(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``kept_given`` for pairs of neighbour numbers."""
        return kept_given(self.p, self.h, self.distance, self.before[i], self.after[j], self.before_h[i], self.after_h[j])

    def _edges(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last peak that stays, where they are close enough to a border to matter."""
        some, top = kept.any(axis=0), len(self.p) - 1
        first = self.p[kept.argmax(axis=0)]
        last = self.p[top - kept[::-1].argmax(axis=0)]
        first = np.where(some & (first < self.low + self.distance - 1), first, NONE)
        return first, np.where(some & (last > self.high - self.distance), last, NONE)

    def answers(self) -> list[tuple[int, int, int, list[int]]]:
        """(after, first, last, befores): what stays at the own borders, for the pairs that can be.

        First each side alone. A neighbour that no staying peak is close to changes nothing. One that a
        staying peak of higher rank is close to cannot be: nothing else would make that peak give way. Only
        if both sides push a peak aside is the pair tried as such.
        """
        n_before, n_after = len(self.before), len(self.after)
        nothing = lambda n: np.zeros(n, int)
        right, right_can = self._run(nothing(n_after), np.arange(n_after))  # no neighbour before
        left, left_can = self._run(np.arange(n_before), nothing(n_before))  # no neighbour after
        right_edges, left_edges = self._edges(right), self._edges(left)

        def met(kept: np.ndarray, at: int, height: float, side: int) -> tuple[np.ndarray, np.ndarray]:
            """Cases where a peak that stays is close to the neighbour, and where it ranks above it."""
            near = np.abs(self.p - at) < self.distance
            above = near & ((self.h > height) | ((self.h == height) & (side < 0)))
            return kept[near].any(axis=0), kept[above].any(axis=0)

        pushed_by_after = [met(left, self.after[j], self.after_h[j], 1) if j else (nothing(n_before) > 0,) * 2 for j in range(n_after)]
        found: dict[tuple[int, int, int], list[int]] = {}
        both = []
        for i in range(n_before):
            pushed, never = met(right, self.before[i], self.before_h[i], -1) if i else (nothing(n_after) > 0,) * 2
            for j in range(n_after):
                if never[j]:
                    continue
                if not pushed[j]:
                    can, first, last = right_can[j], right_edges[0][j], right_edges[1][j]
                elif pushed_by_after[j][1][i]:
                    continue
                elif not pushed_by_after[j][0][i]:
                    can, first, last = left_can[i], left_edges[0][i], left_edges[1][i]
                else:
                    both.append((i, j))
                    continue
                if can:
                    found.setdefault((int(self.after[j]), int(first), int(last)), []).append(int(self.before[i]))
        for at in range(0, len(both), _AT_ONCE):
            i, j = np.array(both[at : at + _AT_ONCE]).T
            kept, possible = self._run(i, j)
            first, last = self._edges(kept)
            for case in np.flatnonzero(possible):
                key = int(self.after[j[case]]), int(first[case]), int(last[case])
                found.setdefault(key, []).append(int(self.before[i[case]]))
        return [(*key, befores) for key, befores in found.items()]

    def settled(self, before: int, after: int) -> pa.Table:
        i, j = self.before.tolist().index(before), self.after.tolist().index(after)
        kept, _ = self._run(np.array([i]), np.array([j]))
        return self.table.filter(pa.array(kept[:, 0]))


def chained(cells: Iterable[tuple[int, list[tuple[int, int, int, list[int]]]]]) -> Iterator[tuple[int, int, int]]:
    """(cell, before, after) that all cells of a record agree on; cells ascend.

    A border has a state: the last peak that stays before it and the first one after it. Forward,
    each cell turns the states its left border may have into those of its right border; backward,
    the one chain that reaches the end is read off. Highest-first decides every peak, so there is
    exactly one.
    """
    trail: list[dict[tuple[int, int], tuple[int, int]]] = []
    numbers: list[int] = []

    def read_off() -> Iterator[tuple[int, int, int]]:
        state = next(s for s in trail[-1] if s[1] == NONE)
        for number, steps in zip(reversed(numbers), reversed(trail)):
            before = steps[state]
            yield number, before[0], state[1]
            state = before

    for number, answers in cells:
        if numbers and numbers[-1] != number - 1:
            yield from read_off()
            trail, numbers = [], []
        by_left: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for after, first, last, befores in answers:
            for before in befores:
                by_left.setdefault((before, first), []).append((last, after))
        # Nothing stays before the first cell of a chain, whatever it keeps first.
        states = trail[-1] if trail else [s for s in by_left if s[0] == NONE]
        trail.append({right: left for left in states for right in by_left.get(left, ())})
        numbers.append(number)
    if numbers:
        yield from read_off()


def spaced_cells(opened: DataFrame, distance: int, keys: Sequence[str] = series.KEYS, size: int = CHUNK) -> DataFrame:
    """The peaks ``p, h`` that stay of ``opened``: at least ``distance`` apart, highest first, later ones on ties.

    No group holds more than a cell (``size`` samples, two distances at least) and the peaks within the
    distance of it; a record's chain holds one row a cell, as many pairs as its border peaks make.
    """
    span = max(size, 2 * distance)
    columns, place = [*keys, "p", "h"], [*keys, "chunk"]
    reach = distance - 1
    placed = series.with_halo(opened.select(*columns), reach, reach, span, "p")
    types = {f.name: f for f in placed.schema}
    schema = T.StructType([types[c] for c in (*keys, "p", "h")])
    names = ("after", "first", "last", "befores")
    longs = T.ArrayType(T.LongType())
    case = T.StructType([T.StructField(n, longs if n == "befores" else T.LongType()) for n in names])
    answer_schema = T.StructType([*[types[c] for c in place], T.StructField("answers", T.ArrayType(case))])
    choice_schema = T.StructType([*[types[c] for c in place], *[T.StructField(n, T.LongType()) for n in ("before", "after")]])

    def answer(group: pa.Table) -> pa.Table:
        cell = Cell(group, span, distance)
        found = [dict(zip(names, a)) for a in cell.answers()] if len(cell.p) else []
        row = group.select(place).slice(0, 1 if found else 0)
        kind = pa.list_(pa.struct([(n, pa.list_(pa.int64()) if n == "befores" else pa.int64()) for n in names]))
        return row.append_column("answers", pa.array([found] if found else [], kind))

    def choose(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        rows = zip(group["chunk"].to_pylist(), group["answers"].to_pylist())
        found = sorted(chained((c, [tuple(a[n] for n in names) for a in answers]) for c, answers in rows))
        out = group.select(place)
        return out.append_column("before", pa.array([f[1] for f in found], pa.int64())).append_column(
            "after", pa.array([f[2] for f in found], pa.int64())
        )

    def settle(group: pa.Table, choice: pa.Table) -> pa.Table:
        if not len(group) or not len(choice):
            return group.select(columns).slice(0, 0)
        cell = Cell(group, span, distance)
        return cell.settled(choice["before"][0].as_py(), choice["after"][0].as_py()).select(columns)

    answers = placed.groupBy(*place).applyInArrow(answer, answer_schema)
    choices = answers.groupBy(*keys).applyInArrow(choose, choice_schema)
    # New column identities: both sides come from the same table, and cogroups need to tell them apart.
    choices = choices.select(*[F.col(c).alias(c) for c in choices.columns])
    return placed.groupBy(*place).cogroup(choices.groupBy(*place)).applyInArrow(settle, schema)
