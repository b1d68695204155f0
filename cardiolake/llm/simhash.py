"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardiolake.llm import jaccard
from cardiolake.llm.shared import components, merged, written

BITS = 64
_AT_ONCE = 1 << 14

# Entry b holds bit i of the byte b in its byte lane i, so 255 rows add up without overflow.
_LANES = np.packbits(
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(256, 8, 1)
    * np.array([1, 0, 0, 0, 0, 0, 0, 0], np.uint8),
    axis=2,
    bitorder="little",
).reshape(256, 8).copy().view("<u8").ravel()


def _add_bits(total: np.ndarray, hashes: np.ndarray) -> None:
    """Add to ``total`` how many ``hashes`` have each of the 64 bits set."""
    lanes = _LANES[hashes.astype("<u8").view(np.uint8)].reshape(-1, 8)
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    total += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text: majority of each bit over the XXH64 of its word shingles.

    A-Z are lower-cased, words are parted by ASCII white space and shingles joined by one space.
    Fewer words than a shingle make one shingle; no words give zero.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not data:
        return 0
    count = max(1, len(data) - words + 1)
    total = np.zeros(BITS, np.int64)
    for low in range(0, count, _AT_ONCE):
        part = data[low : min(low + _AT_ONCE, count) + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(part) >= words else [b" ".join(part)]
        _add_bits(total, np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], np.uint64))
    return int.from_bytes(np.packbits(total * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): the SimHash of every whole text as a signed 64-bit number; NULL counts as empty."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def ball(radius: int, places: list[int]) -> list[int]:
    """Masks that flip up to ``radius`` of the given bit places."""
    return [
        _signed(sum(1 << p for p in chosen))
        for size in range(radius + 1)
        for chosen in combinations(places, size)
    ]


def _variants(fp, masks: list[int]):
    return F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: fp.bitwiseXOR(m))


def candidates(distinct: DataFrame, radius: int) -> DataFrame:
    """The fingerprints that may have another one within ``radius``; loses none that has.

    The 64 bits are cut into three blocks. Two fingerprints within the radius differ in at most
    two thirds of it over some two blocks, so the balls of half that around the 42 or 43 bits of
    those two blocks meet. That takes 3 x 44 keys a fingerprint (radius 4) instead of 2,081, and a
    key is shared by chance only where 2^42 is small against the square of the count. One key is
    shared by at most 44 x 2^22 distinct fingerprints, whatever the copies; no pairs are formed.
    """
    edges = [0, BITS // 3, 2 * BITS // 3, BITS]
    fp = F.col("fp")
    half = (2 * radius // 3 + 1) // 2
    keys = []
    for out in range(3):
        places = [p for b in range(3) if b != out for p in range(edges[b], edges[b + 1])]
        kept = _signed(sum(1 << p for p in places))
        marked = fp.bitwiseAND(F.lit(kept)).bitwiseOR(F.lit(_signed((out + 1) << edges[out])))
        keys.append(_variants(marked, ball(half, places)))
    keyed = distinct.select("fp", F.explode(F.flatten(F.array(*keys))).alias("key"))
    shared = F.expr("min(fp) over (partition by key) <> max(fp) over (partition by key)")
    return keyed.select("fp", shared.alias("shared")).filter("shared").select("fp").distinct()


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(u, v) links that connect exactly what pairs within an even ``radius`` connect.

    Meet in the middle: each fingerprint emits all variants within half the radius. Two emit a
    common variant if and only if they differ in at most ``radius`` bits: they then have a point
    half-way, and any two within half of one point are within the radius of each other. So a
    variant's group needs no further check, and linking each of its members to the least one
    connects it without forming its pairs. A group holds 2,081 distinct fingerprints at most
    (radius 4), so no variant can be hot.
    """
    if radius % 2:
        raise ValueError("an odd radius has no middle; take the next even one and verify pairs")
    masks = ball(radius // 2, list(range(BITS)))
    variants = fps.select("fp", F.explode(_variants(F.col("fp"), masks)).alias("variant"))
    hub = F.expr("min(fp) over (partition by variant)")
    found = variants.select(F.col("fp").alias("u"), hub.alias("v")).filter("u <> v").distinct()
    return found.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words: int = 4
) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    ``fingerprint`` is 16 lowercase hexadecimal digits; fingerprints are linked at ``radius`` or
    fewer differing bits and component_id is the least id reachable over links, the row's own
    included. Texts without words (NULL too) have fingerprint zero and link like any other. Rows
    with NULL ids are grouped too; a component of such rows only has a NULL component_id. Repeated
    rows give repeated rows; no rows give none. Other columns are ignored.

    Copies collapse to one fingerprint before anything is emitted. Candidate fingerprints come from
    ``candidates``, links from ``links``, and components are contracted in the cluster.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    near = written(candidates(distinct.select("fp"), radius), "simhash-near")
    found = components(links(near, radius), "simhash-links")
    roots = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    label = roots.join(least, "root").select("fp", "component_id")
    return prints.join(label, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# --- groups by similarity -------------------------------------------------------------------

# 1,024 bits hold 36 prints of 28 bits, whatever the number of nodes; a pair at likeness 0.8 differs in
# 15 % of its bits, so 280 of 1,024 is more than ten deviations above it and more than ten below chance (512).
PLANES, PRINTS, WIDTH, APART = 16, 36, 28, 280
_STEP = 0x9E3779B97F4A7C15
# Members of a print's variant that may meet pair by pair; more of them are linked to the least one.
_PAIRED = 8


def wide_bits(hashes: np.ndarray) -> np.ndarray:
    """A SimHash of 1,024 bits, as sixteen 64-bit numbers, over the distinct shingles."""
    out = np.zeros(PLANES, np.int64)
    for plane in range(PLANES if len(hashes) else 0):
        total = np.zeros(BITS, np.int64)
        for low in range(0, len(hashes), _AT_ONCE):
            h = hashes[low : low + _AT_ONCE] + np.uint64(plane * _STEP % (1 << 64))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            _add_bits(total, h ^ (h >> np.uint64(31)))
        out[plane] = np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0]
    return out


def wide_prints(docs: DataFrame, chosen: DataFrame, text_col: str, words: int) -> DataFrame:
    """(node, bits, tokens) of the sets of ``chosen`` (node, text1, text2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            sets = [jaccard.shingle_set(t.as_py(), words) for t in batch.column(1).cast(pa.binary())]
            columns = [pa.array([wide_bits(s) for s in sets], longs), pa.array([s.view(np.int64) for s in sets], longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["node", "bits", "tokens"])

    texts = jaccard.texts_of(docs, chosen, text_col)
    return texts.mapInArrow(run, "node long, bits array<long>, tokens array<long>")


def close_cells(near: DataFrame) -> DataFrame:
    """(cell, node): candidates among (node, bits), together where prints connect them.

    Each print emits its ball of radius 1, so two nodes meet where a print differs in at most two
    bits: whether two do does not depend on how many others there are. By chance a key has less than one
    member up to nine million nodes. Where many meet, they are linked to the least of them: links grow with the members, and
    none is left out. Where few meet that are not connected so, they are paired and told apart by
    all bits.
    """
    keys = []
    for i in range(PRINTS):
        word, shift = divmod(i * WIDTH, BITS)
        value = F.shiftrightunsigned(F.col("bits")[word], shift)
        if shift + WIDTH > BITS:
            value = value.bitwiseOR(F.shiftleft(F.col("bits")[word + 1], BITS - shift))
        value = value.bitwiseAND(F.lit((1 << WIDTH) - 1)).bitwiseOR(F.lit(i << 40))
        keys.append(_variants(value, ball(1, list(range(WIDTH)))))
    keyed = near.select("node", F.explode(F.flatten(F.array(*keys))).alias("key"))
    lists = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("hub")).filter("members > 1")
    # A node has 1,044 keys, so neither they nor their lists are broadcast, whatever Spark takes them for.
    met = written(keyed.join(merged(lists), "key"), "alike-met")
    many = met.filter(F.col("members") > _PAIRED).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    joined = written(components(many, "alike-many").withColumnRenamed("root", "part"), "alike-parts")
    few = met.filter(F.col("members") <= _PAIRED).select("key", "node").join(merged(joined), "node", "left")
    few = few.withColumn("part", F.coalesce("part", "node"))
    mixed = few.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("key")
    few = written(few.join(merged(mixed), "key"), "alike-few")
    side = lambda c: few.select("key", F.col("node").alias(c), F.col("part").alias(f"part{c}"))
    pairs = side("u").join(merged(side("v")), "key").filter("partu < partv").select("u", "v").distinct()
    bits = lambda c: near.select(F.col("node").alias(c), F.col("bits").alias(f"bits{c}"))
    differ = sum(F.bit_count(F.col("bitsu")[i].bitwiseXOR(F.col("bitsv")[i])) for i in range(PLANES))
    close = pairs.join(merged(bits("u")), "u").join(merged(bits("v")), "v").filter(differ <= APART).select("u", "v")
    within = joined.select(F.col("node").alias("u"), F.col("part").alias("v"))
    found = components(close.unionByName(within), "alike-cells")
    return found.select(jaccard.cell_of(0, "root"), "node")


def alike(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8
) -> DataFrame:
    """(id, component_id) of every row: texts are linked if their shingle sets have Jaccard >= ``least`` (in hundredths).

    Shingles are those of ``simhash`` and count once a text; component_id is the least id reachable
    over links. Texts without words are one component. Repeated rows, NULL ids and other columns are
    treated as in ``groups``.

    Texts of one shingle set collapse and sets that share too few shingles with any other are left
    behind, without loss. ``close_cells`` brings candidates together by SimHash prints, and every
    link inside a cell is counted on the whole shingle sets, so no link is wrong and none inside a
    cell is left out; the README has the recall of the prints.
    """
    percent = round(100 * least)
    rows, nodes, open_ = jaccard.opened(docs, id_col, text_col, words, percent)
    prints = written(wide_prints(docs, open_.drop("n"), text_col, words), "alike-prints")
    postings = prints.select("node", F.explode("tokens").alias("token"))
    sets = jaccard.shared_postings(postings, open_.select("node", "n"), percent)
    near = written(prints.select("node", "bits").join(merged(sets.select("node").distinct()), "node"), "alike-near")
    links = jaccard.cell_links(close_cells(near), sets, percent)
    label = jaccard.labelled(nodes, components(links, "alike-links"))
    return rows.select("id", "d1", "d2").join(merged(label), ["d1", "d2"]).select(F.col("id").alias(id_col), "component_id")
