"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardiolake.llm.shared import written

SUFFIX = 3
_MODELS: dict[str, "Scorer"] = {}


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, parted by the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def group_of(word: bytes, groups: int) -> int:
    """Output group of a rare word: by its last bytes, which carry language and inflection."""
    return zlib.crc32(word[-SUFFIX:]) % groups


@dataclass
class Shape:
    """Documented bounds of the model: everything else is counted over all training texts."""

    frequent: int = 800  # words with a class of their own
    groups: int = 127  # classes that share the rarer words out
    known: int = 50_000  # words whose counts every task holds; other counts are joined
    dim: int = 16
    noise: int = 64
    batch: int = 1024
    rate: float = 0.1
    seed: int = 3


@dataclass
class Vocabulary:
    """Classes: 0 is the end (also what stands before a text), then frequent words, then groups."""

    shape: Shape
    hot: dict[bytes, int]  # word -> row of hot_class
    hot_class: np.ndarray
    class_counts: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def first_group(self) -> int:
        return len(self.class_counts) - self.shape.groups

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word in the hot table or -1, its class)."""
        get = self.hot.get
        row = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        kind = self.hot_class[row]
        g = self.shape.groups
        for i in np.flatnonzero(row < 0).tolist():
            kind[i] = self.first_group + zlib.crc32(words[i][-SUFFIX:]) % g
        return row, kind


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows; the empty word counts ends. Tasks add up their own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
            )
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                found.update(words_of(text.as_py()))
                found[b""] += 1
                if len(found) > 300_000:
                    yield rows()
        if found:
            yield rows()

    partial = docs.select(text_col).mapInArrow(run, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list:
    """(word, n) of the most frequent words, at most ``most``, in descending order.

    None where the highest counts are shared by more words than that: all are group members then.

    A histogram over sixteenths of the count's binary logarithm (about a thousand rows at most) tells
    from which count on words fit, so that no task sends a list of its own.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    words = counts.filter("word <> X''").select("word", "n", level.alias("level"))
    room, least = most, None
    for r in sorted(words.groupBy("level").count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["level"]
    if least is None:
        return []
    found = words.filter(F.col("level") >= least).select("word", "n").collect()
    return sorted(found, key=lambda r: (-r["n"], bytes(r["word"])))


@dataclass
class Weights:
    """Scores are (r1 @ m1 + r2 @ m2) . q + b for the classes r1, r2 before a token."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    m1: np.ndarray
    m2: np.ndarray

    NAMES = ("r", "q", "b", "m1", "m2")

    @staticmethod
    def start(vocabulary: Vocabulary) -> "Weights":
        """The same start everywhere: class frequencies in b, small random vectors."""
        rng = np.random.default_rng(vocabulary.shape.seed)
        count, dim = len(vocabulary.class_counts), vocabulary.shape.dim
        share = noise_share(vocabulary)
        eye = np.eye(dim, dtype=np.float32)
        return Weights(
            rng.normal(0, 0.3, (count, dim)).astype(np.float32),
            rng.normal(0, 0.1, (count, dim)).astype(np.float32),
            np.log(share).astype(np.float32),
            eye.copy(),
            0.5 * eye,
        )


def noise_share(vocabulary: Vocabulary) -> np.ndarray:
    counts = vocabulary.class_counts + 1.0
    return counts / counts.sum()


def add_rows(out: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """out[index] += rows where an index may repeat: rows are summed by index first."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out[ordered[starts]] += np.add.reduceat(rows[order], starts, axis=0)


class Trainer:
    """Noise-contrastive steps over minibatches that share their noise classes; Adagrad rates."""

    def __init__(self, vocabulary: Vocabulary, seed: int):
        self.shape, self.w = vocabulary.shape, Weights.start(vocabulary)
        share = noise_share(vocabulary)
        self.cumulative = np.cumsum(share)
        self.offset = np.log(self.shape.noise * share).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.seen = {k: np.full(getattr(self.w, k).shape, 1e-3, np.float32) for k in Weights.NAMES}

    def step(self, c1: np.ndarray, c2: np.ndarray, target: np.ndarray) -> None:
        w, size = self.w, len(target)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.shape.noise)), len(w.b) - 1)
        r1, r2, qt, qn = w.r[c1], w.r[c2], w.q[target], w.q[noise]
        guess = r1 @ w.m1 + r2 @ w.m2
        true = np.einsum("ij,ij->i", guess, qt) + w.b[target] - self.offset[target]
        false = guess @ qn.T + (w.b[noise] - self.offset[noise])
        gt = -1 / (1 + np.exp(np.clip(true, -30, 30)))
        gn = 1 / (1 + np.exp(-np.clip(false, -30, 30)))
        dguess = gt[:, None] * qt + gn @ qn
        dq, db, dr = np.zeros_like(w.q), np.zeros_like(w.b), np.zeros_like(w.r)
        add_rows(dq, target, gt[:, None] * guess)
        add_rows(dq, noise, gn.T @ guess)
        db += np.bincount(target, gt, len(db)).astype(np.float32)
        db += np.bincount(noise, gn.sum(0), len(db)).astype(np.float32)
        add_rows(dr, np.concatenate([c1, c2]), np.concatenate([dguess @ w.m1.T, dguess @ w.m2.T]))
        for k, g in (("r", dr), ("q", dq), ("b", db), ("m1", r1.T @ dguess), ("m2", r2.T @ dguess)):
            g /= size
            seen = self.seen[k]
            seen += g * g
            value = getattr(w, k)
            value -= self.shape.rate * g / np.sqrt(seen)


def train(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> Weights:
    """Every task trains on all texts of its part from the common start; weights are averaged by tokens.

    What a task sends is one row per class and matrix, summed before it is shuffled, so the driver
    receives the size of one model however many tasks there are.
    """
    shape = vocabulary.shape
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        trainer, held, seen = None, [], 0

        def feed(last: bool) -> None:
            data = np.concatenate(held, axis=1)
            stop = data.shape[1] if last else data.shape[1] // shape.batch * shape.batch
            for low in range(0, stop, shape.batch):
                trainer.step(*data[:, low : min(low + shape.batch, stop)])
            held[:] = [data[:, stop:]]

        for batch in batches:
            trainer = trainer or Trainer(words, shape.seed)
            for text in batch.column(0):
                _, kind = words.classes(words_of(text.as_py()))
                kind = np.append(kind, 0)
                before = np.concatenate([np.zeros(2, np.int64), kind])
                held.append(np.stack([before[1:-1], before[:-2], kind]))
                seen += len(kind)
                if sum(h.shape[1] for h in held) >= 32 * shape.batch:
                    feed(False)
        if trainer is None:
            return
        feed(True)
        for code, k in enumerate(Weights.NAMES):
            value = getattr(trainer.w, k).astype(np.float64)
            value = value[:, None] if value.ndim == 1 else value
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(value), code, np.int32)),
                    pa.array(np.arange(len(value), dtype=np.int32)),
                    pa.array(np.full(len(value), float(seen))),
                    pa.array(list(value), pa.list_(pa.float64())),
                ],
                names=["part", "row", "weight", "value"],
            )

    sent = docs.select(text_col).mapInArrow(run, "part int, row int, weight double, value array<double>")
    sums = [F.sum(F.get("value", F.lit(i)) * F.col("weight")).alias(f"v{i}") for i in range(shape.dim)]
    means = sent.groupBy("part", "row").agg(F.sum("weight").alias("weight"), *sums).collect()
    w = Weights.start(vocabulary)
    for r in means:
        value = getattr(w, Weights.NAMES[r["part"]])
        if value.ndim == 1:
            value[r["row"]] = r["v0"] / r["weight"]
        else:
            value[r["row"]] = [r[f"v{i}"] / r["weight"] for i in range(shape.dim)]
    shared.unpersist()
    return w


class Scorer:
    """Normalised log10 probabilities of classes after two classes.

    The normaliser of a pair of classes is a matrix product over all classes; it is computed once
    per pair and process, many pairs at a time. ``novel`` is the share of each class that belongs to
    words never seen; together they are the one unknown token.
    """

    def __init__(self, w: Weights, novel: np.ndarray):
        self.w, self.count = w, len(w.b)
        self.a1, self.a2 = w.r @ w.m1, w.r @ w.m2
        self.log_novel = np.log(np.maximum(novel, 1e-30)).astype(np.float32)
        self.log_z = np.full(self.count**2, np.nan, np.float32)
        self.log_unknown = np.full(self.count**2, np.nan, np.float32)

    def _prepare(self, pairs: np.ndarray) -> None:
        new = np.unique(pairs[np.isnan(self.log_z[pairs])])
        for low in range(0, len(new), 2048):
            part = new[low : low + 2048]
            score = (self.a1[part // self.count] + self.a2[part % self.count]) @ self.w.q.T + self.w.b
            top = score.max(axis=1, keepdims=True)
            p = np.exp(score - top)
            z = p.sum(axis=1)
            self.log_z[part] = top[:, 0] + np.log(z)
            self.log_unknown[part] = np.log(np.maximum(p @ np.exp(self.log_novel) / z, 1e-30))

    def score(self, c1: np.ndarray, c2: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the target class and of the unknown token after classes c1 (nearer) and c2."""
        pairs = c1 * self.count + c2
        self._prepare(pairs)
        guess = self.a1[c1] + self.a2[c2]
        own = np.einsum("ij,ij->i", guess, self.w.q[target]) + self.w.b[target] - self.log_z[pairs]
        return own / np.log(10.0), self.log_unknown[pairs] / np.log(10.0)


def score(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    shape: Shape | None = None,
) -> DataFrame:
    """Score every whole text with a model learned from the rows where ``learn`` holds.

    Returns (id, n_tokens, n_known, train_tokens, base_score, score). Tokens are the words and one
    end; a text that is NULL or has no words has the end only. ``base_score`` is the add-one unigram
    score. ``score`` is log10 of the model's probability: the class of a token follows from the two
    classes before it (log-bilinear, normalised over all classes); a rare word then has its
    discounted count's share of its group, and the discounts of all groups form the one unknown
    token. Without any learning rows only the unknown token exists and scores are 0. Repeated rows
    are scored each; other columns are ignored; no rows give no rows.

    Word counts are summed in the cluster and stay there: the tasks hold the ``known`` most frequent
    words, all other tokens meet their counts in a join on the word, where by construction no word is
    hot, and come back as sums per row. Only bounded tables (classes, groups, weights) reach the driver.
    """
    shape = shape or Shape()
    spark = docs.sparkSession
    learning = docs.filter(learn).select(text_col)
    counts = written(count_words(learning, text_col), "lm-counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    hot_rows = frequent_words(counts, shape.known)
    ends = counts.filter("word = X''").first()
    frequent = hot_rows[: shape.frequent]
    groups = np.zeros((shape.groups, 3))
    # All words that come after the frequent ones, by group: tokens, distinct words, words seen once.
    after = F.lit(True)
    if frequent:
        n, word = frequent[-1]["n"], F.lit(bytearray(frequent[-1]["word"]))
        after = (F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > word))
    tail = (
        counts.filter("word <> X''")
        .filter(after)
        .groupBy((F.crc32(F.substring("word", -SUFFIX, SUFFIX)) % shape.groups).alias("g"))
        .agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1))
    )
    for g, n, d, once in tail.collect():
        groups[g] = n, d, once
    sums, kinds, once = groups.T
    discount = np.where(kinds > 0, np.minimum(once / np.maximum(kinds, 1), 0.95), 0.0)
    novel = np.where(kinds > 0, discount * kinds / np.maximum(sums, 1), 1.0)
    first_group = 1 + len(frequent)
    class_counts = np.concatenate([[ends["n"] if ends else 0], [r["n"] for r in frequent], sums])
    hot_class = np.array(
        [i + 1 if i < len(frequent) else first_group + group_of(bytes(r["word"]), shape.groups) for i, r in enumerate(hot_rows)]
        + [0],
        np.int64,
    )
    vocabulary = Vocabulary(shape, {bytes(r["word"]): i for i, r in enumerate(hot_rows)}, hot_class, class_counts)
    weights = train(learning, vocabulary, text_col)

    log_size = np.log10(total + distinct + 1)
    hot_n = np.array([r["n"] for r in hot_rows] + [1.0])
    in_group = hot_class >= first_group
    g = np.where(in_group, hot_class - first_group, 0)
    inside = np.where(in_group, np.log10(np.maximum(hot_n - discount[g], 1e-9) / np.maximum(sums[g], 1)), 0.0)
    end_base = np.log10((ends["n"] if ends else 0) + 1) - log_size
    model = spark.sparkContext.broadcast(
        (vocabulary, weights, np.concatenate([np.zeros(first_group), novel]), inside, np.log10(hot_n + 1) - log_size, discount, sums)
    )
    trained = total > 0
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            docs.schema[id_col],
            T.StructField("word", T.BinaryType()),
            T.StructField("tokens", T.LongType()),
            T.StructField("known", T.LongType()),
            T.StructField("base", T.DoubleType()),
            T.StructField("own", T.DoubleType()),
            T.StructField("unknown", T.DoubleType()),
        ]
    )
    schema[1].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w, share, part_log, base_log, _, _ = model.value
        if words.name not in _MODELS:
            _MODELS.clear()
            _MODELS[words.name] = Scorer(w, share)
        scorer = _MODELS[words.name]
        row = TaskContext.get().partitionId() << 36
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                texts = [words_of(t.as_py()) for t in batch.column(1)]
                found = [words.classes(t) for t in texts]
                kind = np.concatenate([x for _, k in found for x in (k, [0])])
                at = np.concatenate([x for r, _ in found for x in (r, [-2])])
                lengths = np.array([len(t) + 1 for t in texts])
                owner = np.repeat(np.arange(len(texts)), lengths)
                first = np.cumsum(lengths) - lengths
                near = np.concatenate([[0], kind[:-1]])
                near[first] = 0
                far = np.concatenate([[0], near[:-1]])
                far[first] = 0
                own, unknown = np.zeros(len(kind)), np.zeros(len(kind))
                for a in range(0, len(kind), 1 << 16):
                    b = a + (1 << 16)
                    own[a:b], unknown[a:b] = scorer.score(near[a:b], far[a:b], kind[a:b])
                hot, end, rare = at >= 0, at == -2, at == -1
                known = np.maximum(at, 0)
                base = np.where(hot, base_log[known], 0.0) + np.where(end, end_base, 0.0)
                mine = np.where(rare, 0.0, own) + np.where(hot, part_log[known], 0.0)
                n = len(texts)
                flat = [w for t in texts for w in (*t, None)]
                spots = np.flatnonzero(rare)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([row + np.arange(n), row + owner[spots]])),
                        pa.concat_arrays([batch.column(0), pa.nulls(len(spots), batch.column(0).type)]),
                        pa.array([b" %d" % (row + i) for i in range(n)] + [flat[i] for i in spots.tolist()], pa.binary()),
                        pa.array(np.concatenate([lengths, np.zeros(len(spots), np.int64)])),
                        pa.array(np.concatenate([np.bincount(owner, hot | end, n).astype(np.int64), np.zeros(len(spots), np.int64)])),
                        pa.array(np.concatenate([np.bincount(owner, base, n), np.zeros(len(spots))])),
                        pa.array(np.concatenate([np.bincount(owner, mine, n), own[spots]])),
                        pa.array(np.concatenate([np.zeros(n), unknown[spots]])),
                    ],
                    names=schema.names,
                )
                row += n

    rows = docs.select(id_col, text_col).mapInArrow(run, schema)
    if not trained:
        zero = F.lit(0.0)
        return rows.filter("tokens > 0").select(
            id_col,
            F.col("tokens").alias("n_tokens"),
            F.lit(0).cast("long").alias("n_known"),
            F.lit(0).cast("long").alias("train_tokens"),
            zero.alias("base_score"),
            zero.alias("score"),
        )
    # A row of a document has a word that no text can hold (it starts with a space), so none is NULL.
    met = rows.join(counts, "word", "left")
    rare = F.col("tokens") == 0
    group = (F.crc32(F.substring("word", -SUFFIX, SUFFIX)) % shape.groups).cast("int")
    table = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), group)
    share = F.log10((F.col("n") - table(discount)) / table(np.maximum(sums, 1)))
    seen = F.col("n").isNotNull()
    ln = F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) - F.lit(float(log_size))
    parts = met.select(
        "row",
        id_col,
        "tokens",
        (F.col("known") + (rare & seen).cast("long")).alias("known"),
        F.when(rare, ln).otherwise(F.col("base")).alias("base"),
        F.when(rare & seen, F.col("own") + share).when(rare, F.col("unknown")).otherwise(F.col("own")).alias("own"),
    )
    return (
        parts.groupBy("row")
        .agg(
            F.max(id_col).alias(id_col),
            F.sum("tokens").alias("n_tokens"),
            F.sum("known").alias("n_known"),
            F.sum("base").alias("base_score"),
            F.sum("own").alias("score"),
        )
        .select(
            id_col, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
        )
    )
