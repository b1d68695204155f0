"""N-gram Jaccard join: size-aware, subsets of small sets and inverted lists of large ones."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.llm.shared import components, dropped, merged, new_path, written

# Sets of one scan hold about this many shingles; larger collections are cut into blocks of this size.
_SCAN = 100_000
# Rows that a task looks at together.
_ROWS = 1_000
# Subsets are enumerated for sets of at most this many shingles, whatever the cost model says.
_SUBSETS = 24


def least_common(a: Column | int, b: Column | int, percent: int):
    """Fewest common elements with which sets of a and b elements reach ``percent`` (whole numbers)."""
    if isinstance(a, Column) or isinstance(b, Column):
        return F.floor(((a + b) * percent + 99 + percent) / (100 + percent)).cast("long")
    return ((a + b) * percent + 99 + percent) // (100 + percent)


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """Ascending distinct XXH64 values of the word shingles of a UTF-8 text, A-Z lower-cased.

    Words are parted by ASCII white space; fewer than ``words`` make one shingle, none make none.
    """
    parts = data.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)], np.uint64)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def _head(n: int, percent: int) -> tuple[int, int]:
    """(length, shared): of the least ``length`` elements, a set that has a partner shares ``shared``.

    A partner holds all but ``n - common`` elements of the set, so any ``n - common + s`` of them
    hold s common ones. More than one makes a passage that many texts quote no reason to go on.
    """
    common = -(-n * percent // 100)
    shared = min(common, 1 + n // 20)
    return n - common + shared, shared


def _lists(values: pa.Array, owner: np.ndarray, size: int) -> pa.ListArray:
    """Values, ordered by their owner, as one list an owner."""
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=size))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def heads(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, text1, text2, d1, d2, n, sure, need, head, met) of every row.

    (d1, d2) is a 128-bit digest of the shingle set, (text1, text2) one of the text; ``need`` shared
    shingles among the least ones are what a set with a partner has. ``sure`` of them are met in
    another set of the same ``_ROWS`` rows already, and ``head`` holds the others, which the cluster has to
    look up. Of shingles met in a batch only the first holder sends one, as ``met`` with a second holder,
    so a frequent shingle is sent once a batch. A set that its batch has met before sends nothing.
    """
    schema = (
        f"id {docs.schema[id_col].dataType.simpleString()}, text1 long, text2 long, d1 long, d2 long, "
        "n long, sure long, need long, head array<long>, met array<struct<token: long, other: long>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, _ROWS) for whole in batches for low in range(0, max(1, whole.num_rows), _ROWS)):
            size, seen = batch.num_rows, {}
            digests, counts, needs, sure = np.zeros((size, 2), np.int64), np.zeros(size, np.int64), [], np.zeros(size, np.int64)
            tokens, owners = [], []
            for i, data in enumerate(batch.column(3).cast(pa.binary())):
                found = shingle_set(data.as_py() or b"", words)
                digests[i] = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8")
                counts[i] = len(found)
                length, need = _head(len(found), percent)
                needs.append(need)
                if digests[i].tobytes() not in seen and len(found):
                    seen[digests[i].tobytes()] = i
                    tokens.append(found[:length])
                    owners.append(np.full(length, i))
            token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            fresh = np.ones(len(token), bool)
            fresh[1:] = token[1:] != token[:-1]
            start = np.flatnonzero(fresh)
            length = np.diff(np.append(start, len(token)))
            many = np.repeat(length, length) > 1
            np.add.at(sure, owner[many], 1)
            twice = length > 1
            other = digests[owner[start[twice] + 1], 0]
            alone = token[start[~twice]].view(np.int64), owner[start[~twice]]
            first = token[start[twice]].view(np.int64), owner[start[twice]]
            order = np.argsort(first[1], kind="stable")
            pairs = pa.StructArray.from_arrays([pa.array(first[0][order]), pa.array(other[order])], ["token", "other"])
            order = np.argsort(alone[1], kind="stable")
            # A shingle that is sent and sure is looked up too, and must not count twice.
            both = np.bincount(first[1], minlength=size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                    pa.array(counts), pa.array(sure - both), pa.array(needs, pa.int64()),
                    _lists(pa.array(alone[0][order]), alone[1], size), _lists(pairs, first[1], size),
                ],
                names=["id", "text1", "text2", "d1", "d2", "n", "sure", "need", "head", "met"],
            )

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text1"), F.xxhash64(text, F.lit(1)).alias("text2"), text)
    return rows.mapInArrow(run, schema)


def promising(rows: DataFrame) -> DataFrame:
    """d1 of the sets that share enough of their least shingles; loses none that has a partner.

    Sets of equal d1 count as one with the shared shingles of both, which loses none either.
    """
    alone = F.transform("head", lambda t: F.struct(t.alias("token"), F.col("d1").alias("other")))
    sent = rows.select("d1", F.explode(F.concat(alone, "met")).alias("h")).select("d1", "h.token", "h.other")
    over = Window.partitionBy("token")  # one row a batch that has met the shingle
    met = F.min(F.least("d1", "other")).over(over) != F.max(F.greatest("d1", "other")).over(over)
    shared = sent.select("d1", met.alias("met")).filter("met").groupBy("d1").agg(F.count(F.lit(1)).alias("shared"))
    figures = rows.filter("need > 0").groupBy("d1").agg(F.min("need").alias("need"), F.max("sure").alias("sure"))
    both = figures.join(merged(shared), "d1", "left")
    return both.filter(F.col("sure") + F.coalesce("shared", F.lit(0)) >= F.col("need")).select("d1")


def opened(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, open_): every row, every set, and (node, n, text1, text2) of the promising sets."""
    path = new_path(docs.sparkSession, "jaccard-heads")
    found = written(heads(docs, id_col, text_col, words, percent), path=path)
    rows = written(found.select("id", "text1", "text2", "d1", "d2", "n"), "jaccard-rows")
    nodes = written(nodes_of(rows), "jaccard-nodes")
    open_ = nodes.join(merged(promising(found)), "d1").select("node", "n", "text.text1", "text.text2")
    open_ = written(open_, "jaccard-open")
    dropped(docs.sparkSession, path)
    return rows, nodes, open_


def nodes_of(rows: DataFrame) -> DataFrame:
    """(d1, d2, first_id, n, text, node): one row a set, with a number of its own (write it before use)."""
    nodes = rows.groupBy("d1", "d2").agg(
        F.min("id").alias("first_id"), F.max("n").alias("n"), F.min(F.struct("text1", "text2")).alias("text")
    )
    return nodes.withColumn("node", F.monotonically_increasing_id())


def texts_of(docs: DataFrame, chosen: DataFrame, text_col: str) -> DataFrame:
    """(node, text) of the rows of ``chosen`` (node, text1, text2)."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(text).alias("text1"), F.xxhash64(text, F.lit(1)).alias("text2"), text.alias("text"))
    # Chosen sets grow with the input, so they are never broadcast.
    return texts.join(merged(chosen), ["text1", "text2"]).groupBy("node").agg(F.first("text").alias("text"))


def postings(docs: DataFrame, chosen: DataFrame, text_col: str, words: int) -> DataFrame:
    """(node, token) of all shingles of the sets of ``chosen`` (node, text1, text2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"]
            )

    texts = texts_of(docs, chosen, text_col)
    return texts.mapInArrow(run, "node long, tokens array<long>").select("node", F.explode("tokens").alias("token"))


def shared_postings(all_: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(node, n, token, df) of the shingles held by several sets, of the sets whose shared ones may do."""
    path = new_path(all_.sparkSession, "jaccard-shared")
    held = all_.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    found = written(all_.join(merged(held), "token").select("node", "token", "df"), path=path)
    enough = (
        found.groupBy("node")
        .agg(F.count(F.lit(1)).alias("held"))
        .join(merged(sizes), "node")
        .filter(F.col("held") * 100 >= F.col("n") * percent)
        .select("node", "n", "held")
    )
    sets = written(found.join(merged(enough), "node"), "jaccard-sets")
    dropped(all_.sparkSession, path)
    return sets


# --- small sets ---------------------------------------------------------------------------------


def subsets_of(n: int, held: int, largest: int, percent: int) -> int:
    """How many keys a set of n elements, ``held`` of them shared, emits among sets of at most ``largest``."""
    return sum(comb(held, least_common(n, b, percent)) for b in range(1, largest + 1) if _fits(n, b, percent))


def _fits(a: int, b: int, percent: int) -> bool:
    return least_common(a, b, percent) <= min(a, b)


def boundary(sets: DataFrame, percent: int) -> int:
    """The size up to which enumerating subsets costs less than scanning inverted lists.

    Enumerating costs a row a key; scanning a set costs the lengths of its lists. Both are summed by
    size over all sets of at most ``_SUBSETS`` shingles (a bounded number of rows), and the boundary
    with the least total is taken.
    """
    by_set = sets.groupBy("node", "n", "held").agg(F.sum("df").alias("scan"))
    found = (
        by_set.filter(F.col("n") <= _SUBSETS).groupBy("n", "held").agg(F.count(F.lit(1)).alias("sets"), F.sum("scan").alias("scan")).collect()
    )
    cost = lambda x: sum(
        r["sets"] * subsets_of(r["n"], r["held"], x, percent) if r["n"] <= x else r["scan"] for r in found
    )
    return min(range(_SUBSETS + 1), key=cost)


def small_links(sets: DataFrame, largest: int, percent: int) -> DataFrame:
    """(u, v) links that connect what similar pairs of sets of at most ``largest`` shingles connect.

    Sets of a and b elements are similar if and only if they share a subset of c = least_common(a, b)
    elements. A key is (a, b, subset): whoever shares it is similar to all of the other size, so
    members are linked to the least member of either size and no pair is formed or checked.
    """
    small = sets.filter(F.col("n") <= largest).groupBy("node", "n").agg(F.sort_array(F.collect_list("token")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                keys, first = [], []
                data = np.array(tokens, np.int64)
                for b in range(1, largest + 1):
                    if not _fits(n, b, percent):
                        continue
                    low, high = min(n, b), max(n, b)
                    for chosen in combinations(range(len(data)), least_common(n, b, percent)):
                        digest = xxhash.xxh3_128_digest(data[list(chosen)].tobytes())
                        keys.append(bytes([low, high]) + digest)
                        first.append(n == low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node] * len(keys), pa.int64()), pa.array(keys, pa.binary()), pa.array(first, pa.bool_())],
                    names=["node", "key", "low"],
                )

    keyed = small.mapInArrow(run, "node long, key binary, low boolean")
    hubs = keyed.groupBy("key").agg(
        F.min(F.when(F.col("low"), F.col("node"))).alias("a"),
        F.min(F.when(~F.col("low"), F.col("node"))).alias("b"),
        F.min("node").alias("least"),
        F.max("node").alias("most"),
    )
    # Sets of one size need another member only; different sizes need a member of either.
    same = F.substring("key", 1, 1) == F.substring("key", 2, 1)
    hubs = hubs.filter((same & (F.col("least") != F.col("most"))) | (F.col("a").isNotNull() & F.col("b").isNotNull()))
    linked = keyed.join(hubs.select("key", F.col("least").alias("v")), "key")
    return linked.select(F.col("node").alias("u"), "v").filter("u <> v").distinct()


# --- large sets ---------------------------------------------------------------------------------


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, token) of the rarest shared shingles of each set; similar sets have one in common.

    With the shingles of no other set first and then the shared ones, rarest first, a set of n has
    one of its first n - common + 1 shingles in every partner.
    """
    order = Window.partitionBy("node").orderBy("df", "token")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("held"))
    return sets.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= length).select("node", "token")


def cells(prefix: DataFrame) -> DataFrame:
    """(cell, node): collections of sets such that every pair with a common prefix shingle is in one.

    Sets that prefix shingles connect form a unit. A unit of m sets whose lists would be scanned with
    more than m x m / 8 comparisons is one cell; a unit that is only loosely chained is scanned list by
    list, each list a cell. The choice is by cost, and both are exact.
    """
    lists = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("len"), F.min("node").alias("hub")).filter("len > 1")
    placed = written(prefix.join(lists, "token"), "jaccard-prefix")
    unit = components(placed.select(F.col("node").alias("u"), F.col("hub").alias("v")), "jaccard-units")
    unit = written(unit, "jaccard-unit")
    work = placed.groupBy("node").agg(F.sum("len").alias("work"))
    sizes = unit.join(work, "node").groupBy("root").agg(F.sum("work").alias("work"), F.count(F.lit(1)).alias("m"))
    dense = sizes.filter(F.col("m") * F.col("m") <= F.col("work") * 8).select("root")
    loose = unit.join(dense, "root", "left_anti").select("node")
    whole = unit.join(dense, "root").select(cell_of(0, "root"), "node")
    return whole.unionByName(placed.join(loose, "node").select(cell_of(1, "token"), "node"))


def cell_of(kind: int, name: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.col(name).alias("id")).alias("cell")


def blocks(members: DataFrame, percent: int) -> DataFrame:
    """(group, cell, part, node): who meets whom in one scan of bounded size.

    Small cells share a group with others. A large one is cut by size class, where only equal or adjacent
    classes can hold similar sets, and each class into blocks of about ``_SCAN`` shingles; every two
    blocks that may hold a pair are a part of their own.
    """
    ratio = F.lit(float(np.log(100 / percent))) if percent < 100 else F.lit(1.0)
    size_class = F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9).cast("int")
    members = members.withColumn("class", size_class)
    weights = members.groupBy("cell").agg(F.sum("held").alias("weight"))
    by_class = members.groupBy("cell", "class").agg(F.ceil(F.sum("held") / _SCAN).cast("int").alias("count"))
    nearby = by_class.select("cell", (F.col("class") - 1).alias("class"), F.col("count").alias("above"))
    below = by_class.select("cell", (F.col("class") + 1).alias("class"), F.col("count").alias("under"))
    counts = by_class.join(merged(nearby), ["cell", "class"], "left").join(merged(below), ["cell", "class"], "left")
    placed = members.join(merged(counts.join(merged(weights), "cell")), ["cell", "class"])
    own = F.pmod(F.xxhash64("node"), F.col("count")).cast("int")
    part = lambda c, x, d, y: F.struct(c.alias("c"), x.alias("x"), d.alias("d"), y.alias("y"))
    c, x, n = F.col("class"), F.col("x"), F.col("count")
    with_others = F.transform(
        F.filter(F.sequence(F.lit(0), n - 1), lambda y: (y != x) | (n == 1)),
        lambda y: part(c, F.least(x, y), c, F.greatest(x, y)),
    )
    empty = F.slice(with_others, 1, 0)
    upward = F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda y: part(c, x, c + 1, y)))
    downward = F.when(F.col("under") > 0, F.transform(F.sequence(F.lit(0), F.col("under") - 1), lambda y: part(c - 1, y, c, x)))
    split = F.concat(with_others, F.coalesce(upward, empty), F.coalesce(downward, empty))
    one = F.array(part(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    parts = F.when(F.col("weight") <= _SCAN, one).otherwise(split)
    dealt = placed.withColumn("x", own).select("cell", "node", "weight", F.explode(parts).alias("part"))
    return dealt


def scan(sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what similar pairs connect: each set reads the inverted lists of its shingles.

    Sets that are connected already are not read against each other again, so there is one link a
    set at most.
    """
    lengths = np.array([len(s) for s in sets])
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    values, place = np.unique(token, return_inverse=True)
    order = np.argsort(place, kind="stable")
    listed, starts = owner[order], np.append(0, np.cumsum(np.bincount(place, minlength=len(values))))
    begin = np.append(0, np.cumsum(lengths))
    waiting, links = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not waiting[root]:
            continue
        waiting[root] = False
        reached = [root]
        while reached and waiting.any():
            u = reached.pop()
            mine = place[begin[u] : begin[u + 1]]
            spans = starts[mine + 1] - starts[mine]
            at = np.repeat(starts[mine] - np.append(0, np.cumsum(spans)[:-1]), spans) + np.arange(spans.sum())
            common = np.bincount(listed[at], minlength=len(sets))
            near = waiting & (100 * common >= percent * (sizes[u] + sizes - common))
            for v in np.flatnonzero(near).tolist():
                waiting[v] = False
                links.append((u, v))
                reached.append(v)
    return links


def cell_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) links among the sets of each cell: what similar pairs inside cells connect."""
    figures = sets.select("node", "n", "held").distinct()
    # Read several times: written, so that no plan holds the components of the cells more than once.
    members = written(members.join(merged(figures), "node"), "jaccard-cells")
    dealt = blocks(members, percent)
    spark = sets.sparkSession
    bundles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = F.col("weight") <= _SCAN
    group = F.when(small, F.pmod(F.xxhash64("cell"), bundles)).otherwise(F.xxhash64("cell", "part"))
    tokens = sets.groupBy("node", "n").agg(F.collect_list("token").alias("tokens"))
    rows = dealt.select(group.alias("bundle"), F.xxhash64("cell", "part").alias("part"), "node").join(tokens, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def links() -> pa.RecordBatch:
            found = scan([h[1] for h in held], np.array([h[2] for h in held]), percent) if len(held) > 1 else []
            ends = [pa.array([held[e[i]][0] for e in found], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["u", "v"])

        for batch in batches:
            lists = batch.column(3)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, (part, node, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if part != key:
                    if held:
                        yield links()
                    held, key = [], part
                held.append((node, values[offsets[i] : offsets[i + 1]], n))
        if held:
            yield links()

    # A part is read as one run of rows; parts of small cells are dealt by bundle.
    dealt_rows = rows.repartition("bundle").sortWithinPartitions("bundle", "part", "node")
    return dealt_rows.select("part", "node", "n", "tokens").mapInArrow(run, "u long, v long")


def labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(d1, d2, component_id) of every set, by the (node, root) rows of linked ones."""
    found = written(found, "jaccard-roots")
    roots = nodes.select("d1", "d2", "node", "first_id").join(merged(found), "node", "left")
    roots = roots.withColumn("root", F.coalesce("root", "node"))
    first = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return roots.join(first, "root").select("d1", "d2", "component_id")


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id) of every row: sets are linked if their Jaccard is ``percent`` or more.

    A set is a text's distinct word shingles (see ``shingle_set``); NULL, empty and blank texts have none
    and are linked with nothing. component_id is the least id reachable over links, the row's own
    included; rows of one set are linked. NULL ids take part and do not name a component while
    another id can. Repeated rows give repeated rows, no rows give none, other columns are ignored.
    Shingles are compared by 64-bit hashes, sets by 128-bit digests.

    Texts of one set collapse, and sets that share too few of their shingles with any other are left
    behind, both without loss. What stays is joined by size: subsets up to ``boundary``, inverted lists
    above; a large set also meets the small ones. Links, not pairs, are formed.
    """
    rows, nodes, open_ = opened(docs, id_col, text_col, words, percent)
    sets = shared_postings(postings(docs, open_.drop("n"), text_col, words), open_.select("node", "n"), percent)
    largest = boundary(sets, percent)
    # A large set may be similar to small ones of at least its least partner's size.
    scanned = sets.filter(F.col("n") * 100 >= F.lit((largest + 1) * percent))
    links = cell_links(cells(prefixes(scanned, percent)), scanned, percent)
    if largest:
        links = links.unionByName(small_links(sets, largest, percent))
    found = components(links, "jaccard-links")
    label = labelled(nodes, found)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return (
        rows.select("id", "n", "d1", "d2")
        .join(label, ["d1", "d2"])
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
    )
