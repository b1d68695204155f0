"""Substring deduplication by hashing lines and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STOP = re.compile(r"[.!?]+\s+")
MIN_WORDS = 5


def lines_of(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every line, without its line feed."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        yield at, end
        at = end + 1


def sentences_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the sentences of one line; white space after a full stop belongs to it."""
    cuts = [m.end() for m in _STOP.finditer(text, start, end)]
    edges = [start, *(c for c in cuts if c < end), end]
    return list(zip(edges, edges[1:]))


def digest_of(words: list[str]) -> bytes:
    """128 bits of the normalised unit: lower case, one space between words."""
    return xxhash.xxh3_128_digest(" ".join(words).lower().encode("utf-8", "surrogatepass"))


def units_of(text: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of every line and every sentence inside a line that has enough words."""
    for start, end in lines_of(text):
        found = sentences_of(text, start, end)
        if len(found) > 1:
            words = text[start:end].split()
            if len(words) >= min_words:
                yield start, end, digest_of(words)
        for a, b in found:
            words = text[a:b].split()
            if len(words) >= min_words:
                yield a, b, digest_of(words)


def cut(text: str, removed: set[tuple[int, int]], min_words: int) -> tuple[str, list[tuple[int, int]]]:
    """The text without the removed units, and the spans that left it, in original code points.

    A removed line goes with its line feed. A sentence too short to be a unit shares the fate of the
    sentence before it in its line (the first one, that of the next), so no crumbs of a removed
    passage stay behind.
    """
    spans: list[list[int]] = []
    for start, end in lines_of(text):
        found = sentences_of(text, start, end)
        if (start, end) in removed:
            gone = [True] * len(found)
        else:
            fate = [
                (a, b) in removed if len(text[a:b].split()) >= min_words else None for a, b in found
            ]
            before = next((f for f in fate if f is not None), False)
            gone = []
            for f in fate:
                before = before if f is None else f
                gone.append(before)
        for (a, b), g in zip(found, gone):
            if g:
                stop = b + 1 if all(gone) and b == end and b < len(text) else b
                if spans and spans[-1][1] == a:
                    spans[-1][1] = stop
                else:
                    spans.append([a, stop])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return "".join(kept), [(a, b) for a, b in spans if b > a]


def units(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, version, start, stop, digest) of every unit; ``version`` tells texts of one id apart."""
    key = docs.schema[id_col]
    schema = T.StructType(
        [
            T.StructField("id", key.dataType),
            T.StructField("version", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("stop", T.LongType()),
            T.StructField("digest", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                row, start, stop, digest = [], [], [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    for a, b, d in units_of(text or "", min_words):
                        row.append(i)
                        start.append(a)
                        stop.append(b)
                        digest.append(d)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(start, pa.int64()),
                        pa.array(stop, pa.int64()),
                        pa.array(digest, pa.binary()),
                    ],
                    names=schema.names,
                )

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), text_col).mapInArrow(run, schema)


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """All rows of ``docs`` with the repeated units cut from their text, and ``removed``.

    Units are lines, and sentences inside lines, of at least ``min_words`` words; they are compared
    after lower-casing and collapsing white space. Over the whole table the occurrence that comes
    first by (id, place in the text) stays and all others go, also within one document. ``removed``
    lists the spans that left, by original code points. A text may become empty; rows never go.
    NULL texts stay NULL, texts without such units stay as they are, rows with NULL ids rank first.
    Rows that repeat an id and its text count as one document, so they are cut alike. A column named
    removed is replaced; all others pass through.

    The first occurrence of a digest is a minimum, combined before the shuffle, so a line that a
    third of all documents share costs one row a task there. Only repeated digests are joined back,
    by a plain equi-join whose large keys adaptive execution can split. Nothing is sorted by unit,
    and only removed units are gathered, by document.
    """
    rank = F.struct("id", "version", "start")
    found = units(docs, id_col, text_col, min_words)
    repeated = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = (
        found.join(repeated.select("digest", "first"), "digest")
        .filter(~F.struct("id", "version", "start").eqNullSafe(F.col("first")))
        .groupBy("id", "version")
        .agg(F.collect_set(F.struct("start", "stop")).alias("units"))
    )
    kept = [c for c in docs.columns if c != "removed"]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)])
    key, text = F.col(f"c{kept.index(id_col)}"), F.col(f"c{kept.index(text_col)}")
    joined = rows.join(
        gone, key.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("version")), "left"
    ).drop("id", "version")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("removed", T.ArrayType(span))])
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                texts, spans = [], []
                removed = batch.column(len(kept)).to_pylist()
                for text, gone in zip(batch.column(at).to_pylist(), removed):
                    if text and gone:
                        text, left = cut(text, {(u["start"], u["stop"]) for u in gone}, min_words)
                    else:
                        left = []
                    texts.append(text)
                    spans.append([{"start": a, "stop": b} for a, b in left])
                columns = list(batch.columns[: len(kept)])
                columns[at] = pa.array(texts, batch.column(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=schema.names)

    return joined.mapInArrow(run, schema)
