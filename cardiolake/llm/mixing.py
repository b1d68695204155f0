"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over output shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.llm.shared import WORD, merged, written

WEIGHTS = (5.0, 2.0, 1.0)
CELLS = 4096
# Rounds that permute the blocks of a source in a pass.
ROUNDS = 24


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _unit(*parts) -> Column:
    """A uniform number strictly between 0 and 1, fixed by ``parts``."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def hypergeometric(good: Column, total: Column, drawn: Column, unit: Column) -> Column:
    """How many of ``good`` among ``total`` items are drawn, by inverting the distribution at ``unit``.

    Weights follow from their ratios, from eight deviations below the mode to eight above; what lies
    outside is below the precision of a double. Arguments are longs with good, drawn <= total.
    """
    wide = lambda c: c.cast("double")
    all_ = F.greatest(wide(total), F.lit(1.0))
    share = wide(good) / all_
    spread = F.sqrt(
        F.greatest(F.lit(0.0), wide(drawn) * share * (1 - share) * wide(total - drawn) / F.greatest(all_ - 1, F.lit(1.0)))
    )
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - good))
    high = F.least(drawn, good)
    mode = F.floor((wide(drawn) + 1) * (wide(good) + 1) / (wide(total) + 2)).cast("long")
    reach = (F.ceil(spread * 8) + 8).cast("long")
    frame = F.struct(
        good.alias("k"),
        total.alias("n"),
        drawn.alias("d"),
        unit.alias("u"),
        F.greatest(low, F.least(mode, high) - reach).alias("a"),
        F.least(high, F.greatest(mode, low) + reach).alias("b"),
    )

    def weight(f: Column, before: Column, x: Column) -> Column:
        up = wide(f["k"] - x + 1) * wide(f["d"] - x + 1)
        down = wide(x) * wide(f["n"] - f["k"] - f["d"] + x)
        return F.when(x == f["a"], F.lit(1.0)).otherwise(before * up / down)

    def draw(f: Column) -> Column:
        values = F.sequence(f["a"], f["b"])
        start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"))

        def add(acc: Column, x: Column) -> Column:
            return _with(weight(f, acc["w"], x), lambda w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum")))

        def pick(goal: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                def after(w: Column) -> Column:
                    crossed = (acc["sum"] < goal) & (acc["sum"] + w >= goal)
                    return F.struct(
                        w.alias("w"),
                        (acc["sum"] + w).alias("sum"),
                        F.when(crossed, x).otherwise(acc["got"]).alias("got"),
                    )

                return _with(weight(f, acc["w"], x), after)

            first = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), f["b"].alias("got"))
            return F.aggregate(values, first, step, lambda acc: acc["got"])

        return _with(F.aggregate(values, start, add, lambda acc: acc["sum"]) * f["u"], pick)

    return _with(frame, draw)


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, bounds) from rows (source_no, blocks): where each shard's share of a source's draws ends.

    A node of the tree holds an exact quota of blocks per source for a range of shards. It gives its
    left half a multivariate-hypergeometric share, drawn source by source given what is left, and the
    rest to the right half. So quotas add up at every node, every shard gets its even number of
    blocks, and shards differ as random deals do. A node is one row with an entry per source (meant
    for up to some ten thousand sources); nodes are split independently.
    """
    zero = F.lit(0).cast("long")
    entry = F.struct(F.col("source_no").alias("no"), F.col("blocks").alias("q"))
    nodes = quotas.agg(F.sort_array(F.collect_list(entry)).alias("sources")).select(
        F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "sources"
    )
    total = F.aggregate("sources", zero, lambda a, s: a + s["q"])
    nodes = nodes.withColumn("all", total)
    # ends of shard j in the sequence of all blocks: floor(j * all / shards)
    for _ in range((shards - 1).bit_length()):
        low, high, every = F.col("low"), F.col("high"), F.col("all")
        mid = F.expr("(low + high) div 2")
        end = lambda j: F.floor(j.cast("decimal(20,0)") * every.cast("decimal(20,0)") / F.lit(shards)).cast("long")  # noqa: E731, B023
        need = end(mid) - end(low)
        held = F.aggregate("sources", zero, lambda a, s: a + s["q"])

        def take(acc: Column, s: Column) -> Column:
            unit = _unit(F.lit(seed), F.col("low"), F.col("high"), s["no"])
            return _with(
                hypergeometric(s["q"], acc["rest"], acc["need"], unit),
                lambda x: F.struct(
                    (acc["rest"] - s["q"]).alias("rest"),
                    (acc["need"] - x).alias("need"),
                    F.concat(acc["left"], F.array(x)).alias("left"),
                ),
            )

        first = F.struct(held.alias("rest"), need.alias("need"), F.array().cast("array<bigint>").alias("left"))
        shares = nodes.withColumn("left", F.aggregate("sources", first, take, lambda acc: acc["left"]))
        left = F.zip_with("sources", "left", lambda s, x: F.struct(s["no"].alias("no"), x.alias("q")))
        right = F.zip_with("sources", "left", lambda s, x: F.struct(s["no"].alias("no"), (s["q"] - x).alias("q")))
        halves = F.when(
            high - low > 1,
            F.array(
                F.struct(low.alias("low"), mid.alias("high"), left.alias("sources")),
                F.struct(mid.alias("low"), high.alias("high"), right.alias("sources")),
            ),
        ).otherwise(F.array(F.struct(low.alias("low"), high.alias("high"), F.col("sources"))))
        nodes = shares.select("all", F.explode(halves).alias("half")).select("all", "half.*")
    leaves = nodes.select("low", F.explode("sources").alias("s")).select(
        F.col("s.no").alias("source_no"), "low", F.col("s.q").alias("q")
    )
    ends = F.sum("q").over(Window.partitionBy("source_no").orderBy("low"))
    return (
        leaves.withColumn("end", ends)
        .groupBy("source_no")
        .agg(F.sort_array(F.collect_list(F.struct("low", "end"))).alias("pairs"))
        .select("source_no", F.transform("pairs", lambda p: p["end"]).alias("bounds"))
    )


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target``: ``share`` of all sizes by weight, at most ``most`` times a source's own size.

    Needs source_size and weight. What is above a limit is shared again by weight until nothing is;
    each round is one small aggregate, and a source that meets its limit stays there.
    """
    cap = F.col("source_size") * most
    rate = 0.0
    goal = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        full = cap < F.col("weight") * rate
        open_, used = sources.agg(
            F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, cap))
        ).first()
        if not open_:
            break
        now = (goal - (used or 0.0)) / open_
        if now <= rate:
            break
        rate = now
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(rate)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    shards: int = 64,
    block_words: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """Which words of which document go to which shard: one row a document.

    Returns (id, source, digest, size, source_size, target, takes). Size counts words (NULL text: 0).
    Sources in code point order, NULL last, have the ``weights`` in turn. ``takes`` lists
    (pass, block, shard, place, first, last): words first..last-1 of the document, taken in that
    pass over its source, stored in ``shard`` and sorted there by ``place``. A source's taken words
    are its target rounded to whole words; no document is taken over ``ceil(most)`` times.

    A source's documents stand in a hashed order; its words are cut into blocks of ``block_words``.
    Whole passes take every block; the last one takes blocks in permuted order and ends inside one.
    Numbered draws of a source are dealt to the shards by ``split_tree``: disjoint, permuted blocks.

    Only ids, sizes and hashes are shuffled, by (source, cell): a hot source is spread over
    ``CELLS`` cells, whose sums give each cell its start, so no source is ordered in one task.
    Everything is an expression on rows; reruns agree. Empty tables give no rows; documents without
    words take part with no takes; repeated rows are documents of their own; other columns are ignored.
    """
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("digest"), size.alias("size")
        ),
        "mix-sizes",
    )
    sized = sized.withColumn("order", F.xxhash64(F.lit(seed), "id", "digest"))
    sized = sized.withColumn("cell", F.shiftrightunsigned("order", 52).cast("int"))
    cells = written(sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "mix-cells")
    # One row a source from here.
    sources = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    sources = sources.withColumn(
        "source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    )
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.get(turn, F.col("source_no") % len(weights)))
    sources = written(targets(written(sources, "mix-sources"), share, most), "mix-targets")
    goal = F.least(F.round("target").cast("long"), F.floor(F.col("source_size") * most).cast("long"))
    plan = (
        sources.withColumn("goal", goal)
        .withColumn("step", F.lit(block_words).cast("long"))
        .withColumn("n_blocks", F.expr("(source_size + step - 1) div step"))
        .withColumn("passes", F.expr("if(source_size > 0, goal div source_size, 0L)"))
        .withColumn("rest", F.expr("goal - passes * source_size"))
        .withColumn("short", F.expr("n_blocks * step - source_size"))
        .withColumn("turns", F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda e: _keys(seed, e)))
        .withColumn("last_at", _place(F.expr("n_blocks - 1"), F.get("turns", F.col("passes").cast("int"))))
        .withColumn(
            "blocks",
            F.expr(
                "passes * n_blocks + if(rest > 0, least(last_at + 1, (rest + step - 1) div step)"
                " + greatest(0L, (rest + short + step - 1) div step - last_at - 1), 0L)"
            ),
        )
    )
    bounds = split_tree(plan.select("source_no", "blocks"), shards, seed)
    plan = written(plan.join(bounds, "source_no").drop("weight", "goal"), "mix-plan")
    ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0).cast("long")))
    known = starts.drop("cell_size").join(
        plan.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))
    ).drop("own").withColumnsRenamed({"source": "s", "cell": "c"})
    # Sizes are one row a document, small as a file and several times as large in memory.
    rows = sized.join(merged(known), F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).drop("s", "c")
    within = Window.partitionBy("source", "cell").orderBy("order", "id", "digest")
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("cell_start") + F.coalesce(F.sum("size").over(ahead), F.lit(0).cast("long"))
    rows = rows.withColumn("start", start)

    def use(e: Column, b: Column) -> Column:
        """What pass ``e`` takes of the document's words in block ``b``."""
        place = _place(b, F.get("turns", e.cast("int")))

        def words(p: Column) -> Column:
            before = p * F.col("step") - F.when(p > F.col("last_at"), F.col("short")).otherwise(F.lit(0).cast("long"))
            kept = F.when(e < F.col("passes"), F.col("step")).otherwise(F.col("rest") - before)
            first = F.greatest(F.col("start"), b * F.col("step"))
            last = F.least(F.col("start") + F.col("size"), b * F.col("step") + F.least(kept, F.col("step")))
            draw = e * F.col("n_blocks") + p
            shard = F.size(F.filter("bounds", lambda x: x <= draw))
            return F.struct(
                e.cast("int").alias("pass"),
                b.alias("block"),
                shard.alias("shard"),
                F.xxhash64(F.lit(seed), F.lit("place"), "source_no", draw, "order").alias("place"),
                (first - F.col("start")).alias("first"),
                (last - F.col("start")).alias("last"),
            )

        return _with(place, words)

    first_block = F.expr("start div step")
    last_block = F.expr("(start + size - 1) div step")
    passes = F.sequence(F.lit(0).cast("long"), F.col("passes"))
    takes = F.flatten(F.transform(passes, lambda e: F.transform(F.sequence(first_block, last_block), lambda b: use(e, b))))
    takes = F.when(F.col("size") > 0, F.filter(takes, lambda t: t["last"] > t["first"]))
    none = F.array().cast("array<struct<pass:int,block:bigint,shard:int,place:bigint,first:bigint,last:bigint>>")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "digest",
        "size",
        "source_size",
        "target",
        F.coalesce(takes, none).alias("takes"),
    )


def _keys(seed: int, e: Column) -> Column:
    """The round keys of a pass over a source."""
    n = F.greatest(F.col("n_blocks"), F.lit(1).cast("long"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.transform(rounds, lambda r: F.pmod(F.xxhash64(F.lit(seed), F.col("source_no"), e, r), n))


def _place(b: Column, keys: Column) -> Column:
    """Where block ``b`` of a source stands in a pass: a permutation by swap-or-not rounds.

    A round pairs each place x with key - x and swaps the two or not by a hash that both share, so
    every round, and all of them together, permute the places 0 to n - 1 for any n.
    """
    n = F.greatest(F.col("n_blocks"), F.lit(1).cast("long"))

    def step(x: Column, key: Column) -> Column:
        other = F.pmod(key - x, n)
        return F.when(F.xxhash64(key, F.col("source_no"), F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(keys, b.cast("long"), step)


def taken(takes: str | Column = "takes") -> Column:
    """Words taken, repeats counted."""
    return F.aggregate(takes, F.lit(0).cast("long"), lambda a, t: a + t["last"] - t["first"])


def texts(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed rows: each document once per pass that takes any of it, with the text it takes.

    All columns of ``docs`` are kept; a document taken whole keeps its text, otherwise the text is
    cut to the taken words, with the white space that stood before them. Documents must differ in
    (id, text); of repeated rows each is kept with the takes of one.
    """
    plan = mixed.filter(F.size("takes") > 0).select(
        F.col(id_col).alias("id"), "digest", F.struct("size", "takes").alias("p")
    )
    plan = plan.groupBy("id", "digest").agg(F.max("p").alias("p"))
    rows = docs.select(F.struct("*").alias("doc"))  # whatever the columns are called
    own, text = F.col("doc")[id_col], F.col("doc")[text_col]
    found = rows.join(plan, own.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("digest"))).select(
        "doc", "p.size", "p.takes"
    )
    found = found.withColumn("pass", F.explode(F.array_distinct(F.transform("takes", lambda t: t["pass"]))))
    mine = F.filter("takes", lambda t: t["pass"] == F.col("pass"))
    words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    part = lambda t: F.slice(words, (t["first"] + 1).cast("int"), (t["last"] - t["first"]).cast("int"))
    cut = F.array_join(F.transform(mine, lambda t: F.array_join(part(t), "")), "")
    count = F.aggregate(mine, F.lit(0).cast("long"), lambda a, t: a + t["last"] - t["first"])
    kept = F.when(count == F.col("size"), text).otherwise(cut)
    return found.select(*[kept.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
