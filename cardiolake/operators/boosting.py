"""Boosted trees by second-order gradients: one softmax over all classes, several forests in the same scans.

Features are cut into quantile bins once. A round grows one tree a class (one tree for two classes) and
every level of all trees of all forests is one pass: tasks add up gradients by (tree, node,
feature, bin), the sums meet by (tree, node), and only the best split of each node reaches the driver.
A forest may leave one fold out, so cross-validation grows its forests beside the final one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardiolake.operators.staging import written

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Gradients are summed as whole numbers below this: sums do not depend on the order of rows or tasks.
_EXACT = 51
# Bytes of the sums that a task holds; levels with more nodes take several passes.
_SUMS = 64 << 20
# Rows below which another task costs more than it saves.
_ROWS_A_TASK = 2_000
# Rounds after which the rows' margins are written anew.
_ROUNDS_KEPT = 5
# Tasks whose sums of one node meet in one group; more are added up in two steps.
_FAN = 256


@dataclass
class Trees:
    """Trees of one depth as arrays (tree, node); the children of node i are 2i + 1 and 2i + 2."""

    feature: np.ndarray  # -1 in leaves
    bin: np.ndarray  # the last bin that goes left
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, count: int, depth: int) -> Trees:
        shape = (count, (2 << depth) - 1)
        return cls(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape), np.zeros(shape))

    def nodes(self, tree: int, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row of ``bins`` (row, feature) has reached after ``depth`` steps."""
        feature, places = self.feature[tree].astype(np.intp), np.arange(self.feature.shape[1])
        first = np.where(feature >= 0, 2 * places + 1, places)  # a leaf leads to itself
        ends = np.where(feature >= 0, self.bin[tree], 255).astype(np.uint8)
        feature, flat, starts = np.maximum(feature, 0), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        at = np.zeros(len(bins), np.intp)
        for _ in range(depth):
            at = first.take(at) + (flat.take(starts + feature.take(at)) > ends.take(at))
        return at


@dataclass
class Forest:
    """A trained classifier: ``rounds`` holds the trees of each round, one a class (one for two classes)."""

    classes: list[int]
    cuts: list[np.ndarray]  # ascending upper ends of the bins of each feature
    rounds: list[Trees] = field(default_factory=list)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        width = 1 if len(self.classes) == 2 else len(self.classes)
        out = np.zeros((len(bins), width))
        for trees in self.rounds:
            depth = (trees.value.shape[1] + 1).bit_length() - 2
            for k in range(width):
                out[:, k] += trees.value[k, trees.nodes(k, bins, depth)]
        return out

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        found = softmax(self.margins(binned(features, self.cuts)))
        return np.stack([1 - found[:, 0], found[:, 0]], axis=1) if len(self.classes) == 2 else found

    def importances(self) -> list[float]:
        """Mean gain of the splits on each feature, as shares of one."""
        gain, splits = np.zeros(len(self.cuts)), np.zeros(len(self.cuts))
        for trees in self.rounds:
            used = trees.feature >= 0
            np.add.at(gain, trees.feature[used], trees.gain[used])
            np.add.at(splits, trees.feature[used], 1)
        mean = gain / np.maximum(splits, 1)
        return (mean / (mean.sum() or 1)).tolist()


def softmax(margins: np.ndarray) -> np.ndarray:
    """Class shares; the logistic function of a single margin."""
    if margins.shape[1] == 1:
        return 1 / (1 + np.exp(-margins))
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def binned(features: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(row, feature) bin numbers: how many cuts lie below the value. Missing values go above all cuts."""
    out = np.zeros(features.shape, np.uint8)
    for j, ends in enumerate(cuts):
        out[:, j] = np.searchsorted(ends, features[:, j], side="left")
    return out


def as_arrays(df: DataFrame, features: str = "features") -> DataFrame:
    if df.schema[features].dataType.typeName() != "array":
        return df.withColumn(features, vector_to_array(features))
    return df


def feature_cuts(df: DataFrame, max_bins: int, features: str = "features") -> list[np.ndarray]:
    """Ends of at most ``max_bins`` bins of about equal size for each feature; a row a feature reaches the driver."""
    values = df.select(F.posexplode(features).alias("j", "v")).filter(~F.isnan(F.col("v").cast("double")))
    shares = [i / max_bins for i in range(1, max_bins)]
    ends = F.percentile_approx(F.col("v").cast("double"), shares, 10_000)
    found = {r["j"]: np.unique(np.array(r["ends"], float)) for r in values.groupBy("j").agg(ends.alias("ends")).collect()}
    width = df.select(F.max(F.size(features))).first()[0] or 0
    return [found.get(j, np.zeros(0)) for j in range(width)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), width)


def _start(df: DataFrame, cuts: list[np.ndarray], key: Sequence[str], seed: int, last: int) -> DataFrame:
    """(y, weight, fold, draw, x, margins) of every row: bins as bytes, no margins yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(_matrix(batch.column(4), len(cuts)), cuts)
            x = pa.array([r.tobytes() for r in bins], pa.binary())
            nothing = pa.array([[]] * len(bins), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], x, nothing], names=["y", "weight", "fold", "draw", "x", "margins"]
            )

    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(last)
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    draw = F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in key])
    named = {"y": F.col("y").cast("int"), "weight": weight, "fold": fold, "draw": draw}
    rows = df.select(*[c.alias(n) for n, c in named.items()], F.col("features").cast("array<double>").alias("features"))
    return rows.mapInArrow(run, "y int, weight double, fold int, draw long, x binary, margins array<double>")


def drawn(draw: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Rows of a round: a share of them by the hash of the row, whatever the layout."""
    with np.errstate(over="ignore"):
        z = draw.view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) < np.uint64(min(share * 2.0**64, 2.0**64 - 2048))


def columns_of(seed: int, turn: int, tree: int, count: int, share: float) -> np.ndarray:
    """Features that a tree may split on, drawn once, ascending."""
    return np.sort(np.random.default_rng([seed, turn, tree]).permutation(count)[: max(1, int(count * share))])


def gradients(shares: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the log loss for class k, times the row's weight, where its ``softmax`` is ``shares``."""
    p = shares[:, k]
    single = shares.shape[1] == 1
    target = y == 1 if single else y == k
    return (p - target) * weight, np.maximum((1 if single else 2) * p * (1 - p), 1e-16) * weight


def best_split(sums: np.ndarray, penalty: float, least: float, gain: float) -> tuple[float, int, int, float, float]:
    """(gain, feature, bin, g, h) of the best split of a node, g and h of its left side; -1 without one.

    ``sums`` is (feature, bin, 2), of the features that may be split on. The smaller feature and bin win ties; gains that differ by rounding only are ties.
    """
    left = np.cumsum(sums, axis=1)
    g, h = left[0, -1]
    left = left[:, :-1]
    gl, hl = left[..., 0], left[..., 1]
    gr, hr = g - gl, h - hl
    with np.errstate(divide="ignore", invalid="ignore"):
        found = 0.5 * (gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g**2 / (h + penalty)) - gain
    found[(hl < least) | (hr < least)] = -np.inf
    best = found.max(initial=-np.inf)
    if not best > 1e-7:
        return 0.0, -1, 0, 0.0, 0.0
    at = int((found >= best * (1 - 1e-7)).argmax())
    j, b = divmod(at, found.shape[1])
    return float(found.flat[at]), j, b, float(gl.flat[at]), float(hl.flat[at])


def grow(
    df: DataFrame,
    classes: Sequence[int],
    rounds: int,
    depth: int,
    rate: float = 0.1,
    row_share: float = 1.0,
    column_share: float = 1.0,
    penalty: float = 1.0,
    least_weight: float = 1.0,
    least_gain: float = 0.0,
    max_bins: int = 32,
    folds: int = 0,
    key: Sequence[str] = (),
    seed: int = 42,
) -> list[Forest]:
    """Forests for ``df`` (features, y as a position in ``classes``, optional weight and fold).

    The first ``folds`` forests leave their fold out, the last one learns from every row. All of
    them grow in the same passes. Rows of a round are drawn by ``key``, columns once a tree; results do
    not depend on partitions or reruns.
    """
    cuts = feature_cuts(df, max_bins)
    width = 1 if len(classes) == 2 else len(classes)
    count, features = folds + 1, len(cuts)
    drawn_columns = max(1, int(features * column_share))
    forests = [Forest(list(classes), cuts) for _ in range(count)]
    state = written(_start(df, cuts, key, seed, folds))
    per_pass = max(1, _SUMS // (max(features, 1) * max_bins * 16))
    sizes = state.agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("rows")).first()
    total_weight = sizes["weight"] or 0.0
    # Every level reads all rows: they lie in as many parts as tasks run at once, whatever the tables' files were.
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, sizes["rows"] // _ROWS_A_TASK)
    if state.rdd.getNumPartitions() < wanted:
        state = written(state.repartition(wanted))
    tasks = state.rdd.getNumPartitions()
    unit = 2.0 ** min(30, _EXACT - int(total_weight).bit_length())
    pending: list[list[Trees]] = []  # rounds that the written margins do not hold: the trees of each forest

    def decode(batch: pa.RecordBatch, older: list[list[Trees]]) -> tuple[np.ndarray, ...]:
        y, weight, fold, draw = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        x = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(len(y), features)
        flat = batch.column(5).flatten().to_numpy(zero_copy_only=False)
        shape = (len(y), count, width)
        margins = flat.reshape(shape).copy() if len(flat) else np.zeros(shape)
        for trees in older:
            for f, one in enumerate(trees):
                for k in range(width):
                    margins[:, f, k] += one.value[k, one.nodes(k, x, depth)]
        return y, weight, fold, draw, x, margins

    def sums_of(turn: int, level: int, open_: list[tuple[int, int, int]], growing: list[Trees], older: list[list[Trees]]):
        trees: dict[int, dict[int, list[int]]] = {}  # the open nodes of each tree follow each other
        for f, k, i in open_:
            trees.setdefault(f, {}).setdefault(k, []).append(i)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(open_), 2, drawn_columns, max_bins))
            columns = {(f, k): columns_of(seed, turn, f * width + k, features, column_share) for f in trees for k in trees[f]}
            for batch in batches:
                if not batch.num_rows:
                    continue
                y, weight, fold, draw, x, margins = decode(batch, older)
                chosen, low = drawn(draw, turn, row_share), 0
                for f in trees:
                    rows = np.flatnonzero(chosen & ((fold != f) | (f == folds)))
                    mine, shares = x[rows], softmax(margins[rows, f])
                    by_column, index = np.ascontiguousarray(mine.T), np.empty(len(rows), np.intp)
                    for k, nodes in trees[f].items():
                        n, at = len(nodes), growing[f].nodes(k, mine, level)
                        place = np.full((2 << level), n, np.intp)  # rows of closed nodes go behind the others
                        place[nodes] = np.arange(n)
                        start = place[at] * max_bins
                        sides = [np.rint(v * unit) for v in gradients(shares, y[rows], weight[rows], k)]
                        for c, j in enumerate(columns[f, k]):
                            np.add(start, by_column[j], out=index)
                            for side, values in enumerate(sides):
                                found = np.bincount(index, values, (n + 1) * max_bins)
                                total[low : low + n, side, c] += found[: n * max_bins].reshape(n, max_bins)
                        low += n
            met = np.flatnonzero(total.any(axis=(1, 2, 3)))
            columns = [pa.array([open_[i][c] for i in met], pa.int32()) for c in range(3)]
            held = pa.array([total[i].tobytes() for i in met], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, held], names=["forest", "k", "node", "sums"])

        return run

    sums_schema = "forest int, k int, node int, sums binary"
    node = ["forest", "k", "node"]

    def of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        """Each node of sorted rows with its sums added up."""
        key, total = None, np.zeros(0)
        for batch in batches:
            for i, at in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                held = np.frombuffer(batch.column("sums")[i].as_buffer(), np.float64)
                if at == key:
                    total += held
                    continue
                if key is not None:
                    yield key, total
                key, total = at, held.copy()
        if key is not None:
            yield key, total

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, total in of_nodes(batches):
            keys = [pa.array([v], pa.int32()) for v in at]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([total.tobytes()], pa.binary())], names=[*node, "sums"])

    def split_of(turn: int):
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, columns = [], {}
            for at, total in of_nodes(batches):
                tree = at[0] * width + at[1]
                if tree not in columns:
                    columns[tree] = columns_of(seed, turn, tree, features, column_share)
                sums = np.moveaxis(total.reshape(2, drawn_columns, max_bins), 0, 2) / unit
                gain, j, b, gl, hl = best_split(sums, penalty, least_weight, least_gain)
                j = int(columns[tree][j]) if j >= 0 else j
                rows.append((*at, gain, j, b, gl, hl, *sums[0].sum(axis=0).tolist()))
            types = [pa.int32()] * 3 + [pa.float64(), pa.int64(), pa.int64()] + [pa.float64()] * 4
            arrays = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*node, "gain", "feature", "bin", "gl", "hl", "g", "h"])

        return split

    split_schema = "forest int, k int, node int, gain double, feature long, bin long, gl double, hl double, g double, h double"
    for turn in range(rounds if features else 0):
        growing = [Trees.empty(width, depth) for _ in range(count)]
        open_ = [(f, k, 0) for f in range(count) for k in range(width)]
        for level in range(depth):
            splits = []
            for at in range(0, len(open_), per_pass):
                run = sums_of(turn, level, open_[at : at + per_pass], growing, list(pending))
                sums = state.mapInArrow(run, sums_schema)
                if tasks > _FAN:
                    salted = sums.withColumn("_salt", F.spark_partition_id() % _FAN)
                    by_salt = salted.repartition(*node, "_salt").sortWithinPartitions(*node)
                    sums = by_salt.select(*node, "sums").mapInArrow(partial, sums_schema)
                by_node = sums.repartition(*node).sortWithinPartitions(*node)
                splits += by_node.mapInArrow(split_of(turn), split_schema).collect()  # a row a node
            open_ = []
            for s in sorted(splits, key=lambda r: (r["forest"], r["k"], r["node"])):
                trees, k, i = growing[s["forest"]], s["k"], s["node"]
                if level == 0:
                    trees.value[k, 0] = -rate * s["g"] / (s["h"] + penalty)
                if s["feature"] < 0:
                    continue
                trees.feature[k, i], trees.bin[k, i], trees.gain[k, i] = s["feature"], s["bin"], s["gain"]
                for child, g, h in ((2 * i + 1, s["gl"], s["hl"]), (2 * i + 2, s["g"] - s["gl"], s["h"] - s["hl"])):
                    trees.value[k, child] = -rate * g / (h + penalty)
                    open_.append((s["forest"], k, child))
            if not open_:
                break
        for forest, trees in zip(forests, growing):
            forest.rounds.append(trees)
        pending.append(growing)
        if len(pending) == _ROUNDS_KEPT and turn + 1 < rounds:
            older = list(pending)

            def renew(batches: Iterator[pa.RecordBatch], older: list[list[Trees]] = older) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    margins = decode(batch, older)[5].reshape(batch.num_rows, -1)
                    ends = np.arange(len(margins) + 1, dtype=np.int32) * margins.shape[1]
                    lists = pa.ListArray.from_arrays(ends, margins.ravel())
                    yield pa.RecordBatch.from_arrays([*batch.columns[:5], lists], names=batch.schema.names)

            state = written(state.mapInArrow(renew, state.schema))
            pending = []
    return forests


def scored(df: DataFrame, forests: Sequence[Forest], by: str | None = None, features: str = "features") -> DataFrame:
    """Add ``prediction`` (a class) and ``probability array<double>``, one share a class.

    With ``by``, a row is scored by the forest of that number: the one that left its fold out.
    """
    df = as_arrays(df, features)
    schema = T.StructType(
        [*df.schema, T.StructField("prediction", T.IntegerType()), T.StructField("probability", T.ArrayType(T.DoubleType()))]
    )
    classes, width = np.array(forests[0].classes, np.int32), len(forests[0].cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(features), width) if batch.num_rows else np.zeros((0, width))
            if by is None:
                p = forests[0].probabilities(x)
            else:
                which, p = batch.column(by).to_numpy(zero_copy_only=False), np.zeros((len(x), len(classes)))
                for f in np.unique(which):
                    p[which == f] = forests[f].probabilities(x[which == f])
            found = [pa.array(classes[p.argmax(axis=1)] if len(p) else np.zeros(0, np.int32)), pa.array(list(p), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=schema.names)

    return df.mapInArrow(run, schema)
