"""Language identification: a byte convolutional network, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 256
UNKNOWN = "und"


@dataclass
class Network:
    """Byte embedding, filters of several widths, max pooling over a window, softmax over languages."""

    labels: list[str]
    embed: np.ndarray  # (256, d)
    filters: np.ndarray  # (width * d, n); narrower filters are zero in the later places
    bias: np.ndarray  # (n,)
    out: np.ndarray  # (n, languages)
    out_bias: np.ndarray
    width: int

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, width * d): the embedded bytes under the widest filter at each place."""
        x = self.embed[windows]
        b, length, d = x.shape
        view = np.lib.stride_tricks.sliding_window_view(x, self.width, axis=1)  # (b, places, d, width)
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(b, length - self.width + 1, self.width * d)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """Language scores of (n, WINDOW) bytes, a few windows at a time so that they stay in cache."""
        found = []
        for low in range(0, len(windows), 16):
            x = self.columns(windows[low : low + 16])
            y = x.reshape(-1, x.shape[2]) @ self.filters
            top = y.reshape(x.shape[0], x.shape[1], -1).max(axis=1) + self.bias
            found.append(np.maximum(top, 0) @ self.out + self.out_bias)
        return np.concatenate(found) if found else np.zeros((0, len(self.labels)), np.float32)


def windows_of(data: bytes, length: int = WINDOW) -> np.ndarray:
    """Fixed-length windows over all bytes; the last one ends with the text, short texts are padded."""
    if len(data) <= length:
        return np.frombuffer(data.ljust(length, b" "), np.uint8)[None, :]
    starts = [*range(0, len(data) - length, length), len(data) - length]
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)[starts]


def train(
    windows: np.ndarray,
    target: np.ndarray,
    labels: list[str],
    widths: tuple[int, ...] = (2, 3, 4),
    per_width: int = 12,
    dim: int = 6,
    steps: int = 2700,
    seed: int = 11,
) -> Network:
    """Adam over cross-entropy, ``steps`` batches; gradients reach a filter at the place of its maximum."""
    rng = np.random.default_rng(seed)
    width, n = max(widths), per_width * len(widths)
    shape = np.zeros((width, dim, n), np.float32)
    for i, w in enumerate(widths):
        shape[:w, :, i * per_width : (i + 1) * per_width] = 1
    mask = shape.reshape(width * dim, n)
    net = Network(
        labels,
        rng.normal(0, 0.5, (256, dim)).astype(np.float32),
        (rng.normal(0, 1, mask.shape) / np.sqrt(width * dim) * mask).astype(np.float32),
        np.zeros(n, np.float32),
        rng.normal(0, 0.3, (n, len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
        width,
    )
    names = ("embed", "filters", "bias", "out", "out_bias")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    step, size = 0, 32
    while step < steps:
        order = rng.permutation(len(windows))
        for low in range(0, len(order), size):
            if step == steps:
                break
            rate = 0.004 * 0.05 ** (step / steps)
            rows = order[low : low + size]
            bytes_, b = windows[rows], len(rows)
            x = net.columns(bytes_)
            y = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(b, x.shape[1], n)
            at = y.argmax(axis=1)
            top = np.take_along_axis(y, at[:, None, :], 1)[:, 0, :] + net.bias
            h = np.maximum(top, 0)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(b), target[rows]] -= 1
            p /= b
            dh = (p @ net.out.T) * (top > 0)
            seen = x[np.arange(b)[:, None], at]  # (b, n, width * dim)
            dx = dh[:, :, None] * net.filters.T[None]  # (b, n, width * dim)
            g = {
                "filters": np.einsum("bnk,bn->kn", seen, dh) * mask,
                "bias": dh.sum(0),
                "out": h.T @ p,
                "out_bias": p.sum(0),
            }
            places = at[:, :, None] + np.arange(width)
            ids = bytes_[np.arange(b)[:, None, None], places]
            ge = np.zeros_like(net.embed)
            np.add.at(ge, ids.ravel(), dx.reshape(-1, dim))
            g["embed"] = ge
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                setattr(
                    net,
                    k,
                    (getattr(net, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32),
                )
    return net


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 1200,
    windows_each: int = 3,
) -> Network | None:
    """Train on a bounded sample of labelled rows; None where no row has both a text and a language.

    ``per_language`` bounds the rows taken of a language (about: rows are chosen by a hash threshold
    from the language's count, and at most twice as many are read), ``windows_each`` the windows of
    ``WINDOW`` bytes taken of a row. Languages are few: one count a language reaches the driver.
    """
    usable = labelled.select(
        F.xxhash64(F.lit(5), id_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).filter("lang is not null and text is not null and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    room = {k: min(1.0, per_language / n) for k, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for k, s in room.items() for x in (k, s)])[F.col("lang")]
    share = F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))
    span = F.greatest(F.length("text") - WINDOW, F.lit(0))
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(windows_each - 1)), lambda i: (span * i / max(1, windows_each - 1)).cast("int") + 1
    )
    pieces = F.transform(F.array_distinct(starts), lambda s: F.substring(F.col("text"), s, F.lit(WINDOW)))
    rows = (
        usable.filter(share < limit)
        .select("h", "lang", pieces.alias("pieces"))
        .limit(2 * per_language * len(labels))
        .collect()
    )
    index = {k: i for i, k in enumerate(labels)}
    found, target = [], []
    for r in sorted(rows, key=lambda r: (r["h"], r["lang"])):
        for piece in r["pieces"]:
            data = piece.encode("utf-8", "surrogatepass")[:WINDOW]
            found.append(windows_of(data)[0])
            target.append(index[r["lang"]])
    return train(np.array(found), np.array(target), labels)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; only the text decides.

    The windows of a text are scored in batches and their log-probabilities averaged by length;
    score is the probability of the language chosen. NULL texts, texts without a letter and all
    texts where nothing was learned are ``und`` with score 0. Whole texts are read, a block of
    windows at a time. Columns named lang_pred or score are replaced; all others pass through.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType(
        [
            *[docs.schema[c] for c in kept],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                lang, score = label_texts(net, batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names
                )

    return docs.select(*kept).mapInArrow(run, schema)


def label_texts(net: Network | None, texts: list[str | None], block: int = 4096) -> tuple[list[str], list[float]]:
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if net is None:
        return lang, score
    total = np.zeros((len(texts), len(net.labels)))
    count = np.zeros(len(texts), np.int64)
    held, owner = [], []

    def flush():
        if held:
            z = net.logits(np.concatenate(held)).astype(np.float64)
            z -= z.max(axis=1, keepdims=True)
            z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
            np.add.at(total, np.repeat(owner, [len(h) for h in held]), z)
            held.clear()
            owner.clear()

    waiting = 0
    for i, text in enumerate(texts):
        if not text or not any(map(str.isalpha, text)):
            continue
        found = windows_of(text.encode("utf-8", "surrogatepass"))
        count[i] = len(found)
        for low in range(0, len(found), block):
            held.append(found[low : low + block])
            owner.append(i)
            waiting += len(held[-1])
            if waiting >= block:
                flush()
                waiting = 0
    flush()
    for i in np.flatnonzero(count):
        mean = total[i] / count[i]
        p = np.exp(mean - mean.max())
        p /= p.sum()
        best = int(p.argmax())
        lang[i], score[i] = net.labels[best], float(p[best])
    return lang, score


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows where ``learn`` holds and predict all rows."""
    net = fit(docs.filter(learn), id_col, text_col, lang_col)
    return predict(docs, net, id_col, text_col)
