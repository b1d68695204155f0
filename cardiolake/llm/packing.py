"""Packing by power-of-two decomposition: pieces of binary lengths, one piece a sequence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardiolake.llm.tokens import MAX_WORDS, encoder

# sequence_id: 5 bits of length class, 24 bits of task, 34 bits of running number.
_CLASS_SHIFT, _TASK_SHIFT = 58, 34
_DOCS_AT_ONCE = 500


def piece_lengths(count: int, most: int) -> list[int]:
    """Whole pieces of ``most`` ids, then the binary digits of the rest, longest first."""
    rest = count % most
    return [most] * (count // most) + [1 << b for b in reversed(range(most.bit_length())) if rest >> b & 1]


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    most: int = 1024,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Cut every document into pieces of power-of-two length; each piece is a sequence of its own.

    Returns (id, start, length, ids, doc_tokens, sequence_id, offset): ``ids`` are little-endian
    unsigned 32-bit token ids; ``doc_tokens`` counts the document's ids with the end id. As every
    length is a power of two, no sequence is padded and none crosses documents. Sequence ids sort by
    length class, so each class (bucket) is one range of ids: batches of a class need no padding.

    One pass, no shuffle: sequence numbers come from the task and a running number in it, so a
    rerun task gives the same rows. A document of any length is cut piece by piece. NULL or empty
    texts are one piece that holds the end id; repeated rows are packed each on their own; an empty
    table gives no rows. Other columns are ignored, whatever their names. ``max_words`` bounds the
    table of known pieces that a task holds (about 200 bytes each).
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest piece must be a power of two")
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, max_words).encode
        task = TaskContext.get().partitionId() << _TASK_SHIFT
        used = [0] * most.bit_length()
        for batch in batches:
            for low in range(0, batch.num_rows, _DOCS_AT_ONCE):
                part = batch.slice(low, _DOCS_AT_ONCE)
                row, start, length, ids, total, sequence = [], [], [], [], [], []
                for k, data in enumerate(encode(part.column(1).to_pylist())):
                    data += end
                    count, at = len(data) // 4, 0
                    for n in piece_lengths(count, most):
                        c = n.bit_length() - 1
                        row.append(k)
                        start.append(at)
                        length.append(n)
                        ids.append(data[4 * at : 4 * (at + n)])
                        total.append(count)
                        sequence.append((c << _CLASS_SHIFT) + task + used[c])
                        used[c] += 1
                        at += n
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row, pa.int64())),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(total, pa.int64()),
                        pa.array(sequence, pa.int64()),
                        pa.array(np.zeros(len(row), np.int64)),
                    ],
                    names=schema.names,
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder of sequences per length, for training that draws batches of one length."""
    packed.write.partitionBy("length").parquet(path)
