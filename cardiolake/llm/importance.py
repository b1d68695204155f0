"""Importance resampling towards a target distribution, ranked by a distributed radix sort."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.llm.shared import written

# Words are runs of 0-9, a-z (A-Z lower-cased) and anything beyond ASCII; all other ASCII parts them.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_AT_ONCE = 1 << 20  # bytes of a text whose words are held at a time


def word_parts(data: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, in lists of bounded size; a word is never parted."""
    low = 0
    while low < len(data):
        high = min(len(data), low + _AT_ONCE)
        part = data[low:high].translate(_PLAIN)
        if high < len(data):
            cut = part.rfind(b" ") + 1
            while not cut and high < len(data):  # one word of more than the size
                high = min(len(data), high + _AT_ONCE)
                part = data[low:high].translate(_PLAIN)
                cut = part.rfind(b" ") + 1 if high < len(data) else len(part)
            part = part[:cut]
        yield part.split()
        low += len(part)


def feature_buckets(data: bytes, longest: int, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to ``longest`` words, joined by a space: unsigned crc32 modulo ``buckets``."""
    before: list[bytes] = []
    for words in word_parts(data):
        joined = before + words
        for size in range(1, longest + 1):
            runs = words if size == 1 else map(b" ".join, zip(*(joined[max(0, len(before) - size + 1) + i :] for i in range(size))))
            yield np.fromiter(map(zlib.crc32, runs), np.uint32) % np.uint32(buckets)
        before = joined[len(joined) - longest + 1 :] if longest > 1 else []


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends one row a bucket it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0).cast(pa.binary()):
                for found in feature_buckets(data.as_py() or b"", longest, buckets):
                    counts += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], names=["bucket", "n"])

    found = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        total[r["bucket"]] = r["n"]
    return total


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, target over source, floors."""
    n, all_target, all_source = len(source), int(target.sum()), int(source.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float(t + 1) * float(all_source + n) / (float(s + 1) * float(all_target + n))))
            for t, s in zip(target.tolist(), source.tolist())
        ],
        np.int64,
    )


def gumbel(seed: int, doc_id: int | None) -> int:
    """Thousandths of a Gumbel draw that depends on seed and id alone; a NULL id counts as an empty one."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row: an array look-up a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = features = weight = 0
                for k, found in enumerate(feature_buckets(data.as_py() or b"", longest, len(gain))):
                    words += len(found) if k % longest == 0 else 0
                    features += len(found)
                    weight += int(gain[found].sum())
                rows.append((words, features, weight, weight + gumbel(seed, doc_id)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight", "score"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _keys(rows: DataFrame, order: Sequence[tuple[str, bool]]) -> tuple[list[Column], list[int]]:
    """Unsigned numbers that ascend in the wanted order, NULL last, and how many bits each takes."""
    ends = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c, _ in order for f in (F.min, F.max)]).first()
    keys, bits = [], []
    for c, down in order:
        low, high = ends[f"min_{c}"], ends[f"max_{c}"]
        if low is None:
            low = high = 0
        if high - low < (1 << 62):
            key = F.lit(high) - F.col(c) if down else F.col(c) - F.lit(low)
            last, width = high - low + 1, (high - low + 1).bit_length()
            keys.append(F.coalesce(key, F.lit(last)))
        else:  # the sign bit turned makes an unsigned number; NULL sorts with the last one
            turned = F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
            keys.append(F.coalesce(F.bitwise_not(turned) if down else turned, F.lit(-1)))
            width = 64
        bits.append(width)
    return keys, bits


def radix_ranks(
    rows: DataFrame, order: Sequence[tuple[str, bool]], digit_bits: int = 12, block: int = 1 << 16
) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3 ...) by the integer columns of ``order`` (name, descending).

    Least significant digit first. A pass counts digits per block of ``block`` rows, turns the counts
    into global offsets (digits before, then blocks before), and moves a row to its offset plus its
    place among the equal digits of its block. That keeps the order of earlier passes, so after
    the most significant digit a row's place is its rank. Rows need a unique long ``place`` with at most
    ``block`` of them to any value of ``place div block``. No task holds more than a block for a
    digit, however many rows are equal. Rows that are equal in all of ``order`` are ranked by place.
    """
    keys, widths = _keys(rows, order)
    names = [f"_key{i}" for i in range(len(keys))]
    rows = rows.withColumns(dict(zip(names, keys)))
    digits = [
        (F.shiftrightunsigned(name, shift).bitwiseAND(F.lit((1 << digit_bits) - 1)).cast("int"))
        for name, width in list(zip(names, widths))[::-1]
        for shift in range(0, width, digit_bits)
    ]
    for digit in digits:
        placed = rows.withColumns({"_block": F.expr(f"place div {block}"), "_digit": digit})
        counts = placed.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))
        below = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)  # a row a digit value
        smaller = totals.select("_digit", F.coalesce(F.sum("_all").over(below), F.lit(0)).alias("_smaller"))
        offsets = counts.join(smaller, "_digit").select(
            "_digit", "_block", (F.col("_smaller") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_offset")
        )
        inside = F.row_number().over(Window.partitionBy("_digit", "_block").orderBy("place")) - 1
        moved = placed.withColumn("_inside", inside).join(offsets, ["_digit", "_block"])
        moved = moved.withColumn("place", F.col("_offset") + F.col("_inside"))
        rows = written(moved.drop("_block", "_digit", "_inside", "_offset"), "radix")
    return rows.withColumn("rank", F.col("place") + 1).drop("place", *names)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``percent`` of the long enough documents, drawn towards ``target``.

    Feature counts of both sides go by hash bucket. A document's weight is the sum of its buckets' gains
    and its score adds a Gumbel draw, so the highest scores are a sample without replacement with
    chances by weight. Of the N documents with ``least_words`` words floor(percent * N / 100) get a
    rank, by score and then by id; all others have a NULL rank. NULL and empty texts have no
    features; a NULL id draws as an empty one and comes last among equal scores. Repeated rows are
    rows of their own. Without documents there are no rows, without a target all gains come
    from smoothing. Other columns of both tables are ignored.
    """
    gain = gains(bucket_counts(target, text_col, longest, buckets), bucket_counts(docs, text_col, longest, buckets))
    scored = weights(docs, gain, id_col, text_col, longest, seed).withColumn("row", F.monotonically_increasing_id())
    scored = written(scored, "importance")
    open_ = scored.filter(F.col("n_words") >= least_words).select("doc_id", "score", "row", F.col("row").alias("place"))
    draw = open_.count() * percent // 100
    ranked = radix_ranks(open_, [("score", True), ("doc_id", False)]).filter(F.col("rank") <= draw)
    return scored.join(ranked.select("row", "rank"), "row", "left").select(
        "doc_id", "n_features", "weight", "score", "rank"
    )
