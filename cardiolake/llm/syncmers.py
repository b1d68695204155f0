"""Document fingerprints from closed syncmers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardiolake.llm.shared import position, range_cuts, shuffle_parts

# Fixed values of the 64-bit mixing steps (odd multipliers of a public finaliser).
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
K, S, SIZE = 16, 8, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


def _itself(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Short data as its own anchor, at place 0."""
    h = np.array([len(data)], np.uint64)
    for w in np.frombuffer(data.ljust(-(-len(data) // 8) * 8, b"\0"), "<u8"):
        h = _mix(h * _M2 ^ w)
    return np.zeros(1, np.int64), h


def syncmers(data: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(byte positions, 64-bit hashes) of the closed syncmers of ``data``.

    A k-mer is kept if the least hash among its s-mers lies at its first or last place. That depends
    on its own bytes only, so equal passages carry equal anchors wherever they stand. ``data`` of
    fewer than k bytes, or without a closed syncmer (below 2k - s - 1 bytes), has one anchor, itself;
    empty data has none. 1 <= s <= 8 <= k, s < k.
    """
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < k:
        return _itself(data)
    words = np.ndarray((len(data) - 7,), "<u8", data + b"\0", 0, (1,))  # the 8 bytes from each place on
    if s < 8:
        tail = np.frombuffer(data[-8:] + b"\0" * 8, np.uint8)
        more = [int.from_bytes(tail[i : i + 8].tobytes(), "little") for i in range(1, 9 - s)]
        inner = np.append(words, np.array(more, np.uint64)) & np.uint64((1 << 8 * s) - 1)
    else:
        inner = words
    h = _mix(inner * _M2)
    count, span = len(data) - k + 1, k - s + 1
    least, width = h, 1
    while width < span:  # the least of `width` s-mers from each place on
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    least = least[:count]
    at = np.flatnonzero((h[:count] == least) | (h[span - 1 : span - 1 + count] == least))
    if not len(at):
        return _itself(data)
    value = np.zeros(len(at), np.uint64)
    for place in [*range(0, k - 8, 8), k - 8]:
        value = _mix(value * _M2 ^ words[at + place])
    return at, value


def sketch(data: bytes, k: int = K, s: int = S, size: int = SIZE) -> np.ndarray:
    """The ``size`` least distinct 32-bit anchor hashes, ascending."""
    return np.unique((syncmers(data, k, s)[1] >> np.uint64(32)).astype(np.uint32))[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of common anchors: over the ``size`` least of both. Two empty sketches are alike."""
    both = np.union1d(a, b)[:size]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b)).sum() / len(both))


def as_text(value: np.ndarray) -> str:
    """Eight hexadecimal digits an anchor."""
    return value.astype(">u4").tobytes().hex()


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(id, position, anchor): every closed syncmer of every text, by UTF-8 byte position.

    NULL and empty texts have none. Joins on ``anchor`` align equal passages; positions tell where.
    """
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("position", T.LongType()), T.StructField("anchor", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                at, value = syncmers((text.as_py() or "").encode("utf-8", "surrogatepass"), k, s)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.full(len(at), row))),
                        pa.array(at.astype(np.int64)),
                        pa.array(value.view(np.int64)),
                    ],
                    names=schema.names,
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness to it and to the next document.

    Documents are ordered by id, then text; NULL ids come first. The last quarter of a text (rounded
    down, in code points) is replaced by the start of the next document; the first follows the last.
    A fingerprint is the bottom sketch of the text's closed syncmers: 64 hashes of 32 bits whatever
    the length, equal for equal texts; NULL counts as empty, and empty texts have the empty
    fingerprint. Repeated rows are documents of their own. No rows give no rows.

    Texts move once, to ranges of ids; a range also receives the first row of the next one, so
    neighbours meet without a global window. A task holds two documents at a time.
    """
    spark = docs.sparkSession
    parts = 2 * shuffle_parts(spark)
    key = F.col("key")
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = range_cuts(rows.select("key"), "key", parts)
    placed = rows.withColumn("bucket", position(cuts, key))
    # One row a range: bounded by the number of ranges, read from the id column only.
    firsts = (
        placed.groupBy("bucket")
        .agg(F.min("key").alias("first"), F.count_if(key.isNull()).alias("nulls"))
        .orderBy("bucket")
        .collect()
    )
    before = {r["bucket"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    heads = [None if r["nulls"] else r["first"] for r in firsts]
    known = sorted((h, before[r["bucket"]]) for h, r in zip(heads, firsts) if h is not None)
    null_to = next((before[r["bucket"]] for h, r in zip(heads, firsts) if h is None), None)
    ids = [h for h, _ in known]
    at = position(ids, key)
    owner = F.get(F.array(*[F.lit(b) for _, b in known]), at - 1) if known else F.lit(None)
    is_head = F.get(F.array(*[F.lit(h) for h in ids]), at - 1) == key if known else F.lit(False)
    to = F.when(key.isNull(), F.lit(null_to)).when(is_head, owner)
    copies = F.array_compact(
        F.array(
            F.struct(F.col("bucket"), F.lit(0).alias("guest")),
            F.when(to.isNotNull(), F.struct(to.cast("int").alias("bucket"), F.lit(1).alias("guest"))),
        )
    )
    dealt = placed.select("key", "text", F.explode(copies).alias("at")).select("at.*", "key", "text")
    ordered = dealt.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "guest", "key", "text")
    schema = T.StructType(
        [
            docs.schema[id_col],
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []  # last: (bucket, guest, key, text, sketch)

        def compare(now):
            _, _, k, text, own = last
            cut = len(text) // 4
            data = (text[: len(text) - cut] + now[3][:cut]).encode("utf-8", "surrogatepass")
            other = sketch(data)
            out.append(
                (
                    k,
                    len(text),
                    hashlib.sha256(data).hexdigest(),
                    as_text(own),
                    as_text(other),
                    likeness(own, other),
                    likeness(own, now[4]),
                )
            )

        def batch_of(rows):
            columns = list(zip(*rows)) or [[]] * 7
            types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=schema.names
            )

        key_type = None
        for batch in batches:
            key_type = batch.column(2).type
            for bucket, guest, k, text in zip(*(batch.column(i) for i in range(4))):
                bucket, guest, text = bucket.as_py(), guest.as_py(), text.as_py()
                if last and last[0] == bucket and last[1]:
                    continue  # a further row that shares the first id of the next range
                now = (bucket, guest, k.as_py(), text, sketch(text.encode("utf-8", "surrogatepass")))
                if last and last[0] == bucket:
                    compare(now)
                last = now
                if len(out) >= 1000:
                    yield batch_of(out)
                    out.clear()
        if out:
            yield batch_of(out)

    return ordered.mapInArrow(run, schema)
