"""Token ids in Arrow files of fixed-size lists: equal-length sequences and masks, read in place."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.llm.shared import new_path, position, range_cuts, shuffle_parts, written
from cardiolake.llm.tokens import MAX_WORDS, encoder

_DOCS_AT_ONCE = 500
_ROWS_IN_BATCH = 256


def _id_type(id_count: int) -> tuple[str, pa.DataType]:
    return ("<u2", pa.uint16()) if id_count <= 1 << 16 else ("<u4", pa.uint32())


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark would use for it, so executors open the same place."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


class ShardWriter:
    """Two Arrow files: sequences of ``length`` ids with a mask, and the documents that they hold.

    Sequences file: record batches of ``_ROWS_IN_BATCH`` rows (the last one may be shorter) with
    columns ids: fixed_size_list<uint16 or uint32>[length] and mask: fixed_size_list<bool>[length],
    uncompressed, so row r is at a computable place of a mapped file. The last row is padded with
    zeros under a false mask. Documents file: (doc_id, start, n_tokens), start counted in the shard.
    """

    def __init__(self, folder: str, bucket: int, length: int, id_count: int, key_type: pa.DataType):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.name = f"shard-{bucket:08d}-{uuid.uuid4().hex}"  # a repeated attempt writes its own files
        self.length, (self.kind, id_type) = length, _id_type(id_count)
        self.fs.create_dir(root, recursive=True)
        self.schema = pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", key_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.fs.open_output_stream(f"{root}/{self.name}.arrow")
        self.index_out = self.fs.open_output_stream(f"{root}/{self.name}.index.arrow")
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.index = pa.ipc.new_file(self.index_out, self.index_schema)
        self.pending: list[np.ndarray] = []
        self.held = self.tokens = self.docs = 0

    def add(self, keys: pa.Array, ids: list[np.ndarray]) -> None:
        counts = np.array([len(x) for x in ids], np.int64)
        starts = self.tokens + np.cumsum(counts) - counts
        self.index.write_batch(
            pa.record_batch([keys, pa.array(starts), pa.array(counts)], schema=self.index_schema)
        )
        self.tokens += int(counts.sum())
        self.docs += len(ids)
        for x in ids:
            self.pending.append(x)
            self.held += len(x)
            if self.held >= self.length * _ROWS_IN_BATCH:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        data = np.concatenate(self.pending) if self.pending else np.zeros(0, self.kind)
        block = self.length * _ROWS_IN_BATCH
        whole = len(data) if last else len(data) // block * block
        for low in range(0, whole, block):
            part = data[low : min(low + block, whole)]
            rows = -(-len(part) // self.length)
            ids = np.zeros(rows * self.length, self.kind)
            ids[: len(part)] = part
            mask = np.arange(len(ids)) < len(part)
            self.file.write_batch(
                pa.record_batch(
                    [
                        pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
                        pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
                    ],
                    schema=self.schema,
                )
            )
        self.pending = [data[whole:]] if whole < len(data) else []
        self.held = len(data) - whole

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        for x in (self.file, self.index, self.out, self.index_out):
            x.close()
        return self.name, self.docs, self.tokens


class ShardReader:
    """Random access to one shard: sequences by row, ids by token position, without copying rows."""

    def __init__(self, folder: str, name: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        opened = lambda p: pa.memory_map(p) if local else fs.open_input_file(p)
        self.file = pa.ipc.open_file(opened(f"{root}/{name}.arrow"))
        self.index = pa.ipc.open_file(opened(f"{root}/{name}.index.arrow"))
        self.length = self.file.schema.field("ids").type.list_size

    def batch(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one record batch as a (rows, length) view of the file, and its mask."""
        batch = self.file.get_batch(number)
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length)
        mask = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.length)
        return ids, mask

    def row(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(number // _ROWS_IN_BATCH)
        return ids[number % _ROWS_IN_BATCH], mask[number % _ROWS_IN_BATCH]

    def documents(self) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
        """(doc_ids, starts, ids of each) block by block; holds one sequence batch and one document."""
        block = self.length * _ROWS_IN_BATCH
        at, flat = -1, np.zeros(0)
        for k in range(self.index.num_record_batches):
            part = self.index.get_batch(k)
            starts, counts = part.column(1).to_numpy(), part.column(2).to_numpy()
            ids = []
            for start, count in zip(starts.tolist(), counts.tolist()):
                pieces = []
                while count:
                    if start // block != at:
                        at = start // block
                        found, mask = self.batch(at)
                        flat = found.reshape(-1)[mask.reshape(-1)]
                    piece = flat[start - at * block : start - at * block + count]
                    if not len(piece):
                        raise ValueError("the shard ends before its last document")
                    pieces.append(piece)
                    start, count = start + len(piece), count - len(piece)
                ids.append(pieces[0] if len(pieces) == 1 else np.concatenate(pieces or [np.zeros(0, flat.dtype)]))
            yield part.column(0), starts, ids


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    length: int = 2048,
    shards: int | None = None,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Write all documents in ascending order of their id and return the manifest, one row a shard.

    The manifest (shard, name, docs, tokens, base) lists the files that count, in order of ids;
    ``base`` is the number of ids in the shards before. Rows are dealt to ``shards`` ranges of ids
    (twice ``spark.sql.shuffle.partitions`` unless given), so shards hold like shares of the rows
    and one shuffle moves each text once. Attempts that were lost leave files that no manifest names.
    NULL ids come first; rows of one id are ordered by their text. NULL texts hold the end id only.
    """
    spark = docs.sparkSession
    key, text = F.col(id_col), F.col(text_col)
    parts = shards or 2 * shuffle_parts(spark)
    cuts = range_cuts(docs.select(id_col), id_col, parts)
    placed = docs.select(position(cuts, key).alias("bucket"), key.alias("key"), text.alias("text"))
    ordered = placed.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer, max_words)
        kind, _ = _id_type(max(tool.id_count, end_id + 1))
        end = np.array([end_id], kind)
        writer, at, done = None, None, []
        for batch in batches:
            for low in range(0, batch.num_rows, _DOCS_AT_ONCE):
                part = batch.slice(low, _DOCS_AT_ONCE)
                buckets = np.asarray(part.column(0))
                edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1), len(buckets)]
                for a, b in zip(edges, edges[1:]):
                    if buckets[a] != at:
                        if writer:
                            done.append((at, *writer.close()))
                        at = int(buckets[a])
                        writer = ShardWriter(folder, at, length, max(tool.id_count, end_id + 1), part.column(1).type)
                    texts = part.column(2).slice(a, b - a).to_pylist()
                    ids = [np.append(np.frombuffer(x, "<u4").astype(kind), end) for x in tool.encode(texts)]
                    writer.add(part.column(1).slice(a, b - a), ids)
        if writer:
            done.append((at, *writer.close()))
        columns = list(zip(*done)) or [[], [], [], []]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "name", "docs", "tokens"]
        )

    # Written, so that the files named here are the ones read later; one row a shard.
    found = written(ordered.mapInArrow(run, "shard int, name string, docs long, tokens long"), "token-manifest")
    base, rows = 0, []
    for r in found.orderBy("shard").collect():
        rows.append((*r, base))
        base += r["tokens"]
    return spark.createDataFrame(rows, "shard int, name string, docs long, tokens long, base long")


def read(spark: SparkSession, manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, ids) of every document: ids little-endian unsigned 32-bit, start over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for keys, starts, ids in ShardReader(folder, name).documents():
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys,
                            pa.array(starts + base),
                            pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        ],
                        names=["doc_id", "start", "ids"],
                    )

    spread = manifest.select("name", "base").repartition(max(1, shuffle_parts(spark)))
    return spread.mapInArrow(run, f"doc_id {id_type}, start long, ids binary")


def roundtrip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", **options) -> DataFrame:
    """Write ``docs`` to a new folder and read the files back."""
    spark = docs.sparkSession
    folder = qualified(spark, new_path(spark, "token-files"))
    manifest = write(docs, folder, tokenizer, id_col, **options)
    return read(spark, manifest, folder, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("doc_id", id_col)
