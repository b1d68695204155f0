import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cardiolake.llm import mixing
from cardiolake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes, weights=(5.0, 2.0, 1.0)):
    """Share 150 % by weight; what is above twice a size is shared again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        if not open_:
            return fixed
        rate = (total - sum(fixed.values())) / sum(w[s] for s in open_)
        full = [s for s in open_ if w[s] * rate > 2 * sizes[s]]
        if not full:
            return fixed | {s: w[s] * rate for s in open_}
        fixed |= {s: 2.0 * sizes[s] for s in full}


def test_mix_query(spark, sf001):
    rows = QUERIES["op9_mixing_tree"](spark, "/root/testdata/sf0.001").collect()
    again = QUERIES["op9_mixing_tree"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(rows) == sorted(again)
    docs = {r["doc_id"]: r for r in sf001.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for d in docs.values():
        sizes[d["source"]] += len(WORD.findall(d["text"]))
    goal = slow_targets(sizes)
    assert len(rows) == len(docs)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == len(WORD.findall(docs[r["doc_id"]]["text"]))
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(goal[source], rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in sizes)


def test_blocks_stand_in_permuted_order(spark):
    """Every place once, for any number of blocks; no rotation, and passes and sources differ."""
    sizes = (1, 2, 3, 6, 7, 9, 11, 31, 63, 126, 200)
    rows = [(n, s, e, b) for n in sizes for s in range(2) for e in range(2) for b in range(n)]
    df = spark.createDataFrame(rows, "n_blocks long, source_no long, e long, b long")
    placed = df.withColumn("place", mixing._place(F.col("b"), mixing._keys(5, F.col("e")))).collect()
    order = defaultdict(dict)
    for r in placed:
        order[r["n_blocks"], r["source_no"], r["e"]][r["b"]] = r["place"]
    for (n, _, _), at in order.items():
        assert sorted(at.values()) == list(range(n))
        steps = Counter((at[b + 1] - at[b]) % n for b in range(n - 1))
        assert n < 31 or max(steps.values()) < n / 4
    for n in (31, 63, 126, 200):
        kinds = [tuple(order[n, s, e][b] for b in range(n)) for s in range(2) for e in range(2)]
        assert len(set(kinds)) == 4


@pytest.mark.parametrize("block_words", [1, 7, 64])
def test_blocks_shards_and_texts(spark, sf001, block_words):
    docs = sf001.filter("doc_id < 40")
    mixed = mixing.mix(docs, shards=5, block_words=block_words, seed=3)
    rows = mixed.collect()
    per_shard = defaultdict(set)
    for r in rows:
        spans = defaultdict(list)
        for t in r["takes"]:
            assert 0 <= t["shard"] < 5 and 0 <= t["first"] < t["last"] <= r["size"]
            spans[t["pass"]].append((t["first"], t["last"]))
            per_shard[t["shard"]].add((r["source"], t["pass"], t["block"]))
        for p, found in spans.items():
            assert found == sorted(found) and all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    counts = [len(v) for v in per_shard.values()]
    blocks = set().union(*per_shard.values())
    assert sum(counts) == len(blocks)  # a block of a pass lies in one shard
    assert max(counts) - min(counts) <= 1 or block_words == 64
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = sum(mixing_row["last"] - mixing_row["first"] for r in rows for mixing_row in r["takes"])
    out = mixing.texts(docs.withColumns({c: F.lit(0) for c in ("id", "digest", "takes", "pass", "p")}), mixed).collect()
    assert sum(len(WORD.findall(r["text"])) for r in out) == words
    by_doc = {r["doc_id"]: r for r in rows}
    for r in out:
        if len(WORD.findall(r["text"])) == by_doc[r["doc_id"]]["size"]:
            assert r["text"] == texts[r["doc_id"]]


def hypergeometric_row(good, total, drawn):
    lo, hi = max(0, drawn - (total - good)), min(drawn, good)
    p = [math.comb(good, x) * math.comb(total - good, drawn - x) / math.comb(total, drawn) for x in range(lo, hi + 1)]
    return lo, p


@pytest.mark.parametrize("good,total,drawn", [(0, 0, 0), (0, 9, 4), (9, 9, 4), (3, 10, 10), (5, 12, 7), (40, 100, 30), (600, 2000, 900)])
def test_hypergeometric_inverts_the_distribution(spark, good, total, drawn):
    n = 400
    cols = [F.lit(v).cast("long") for v in (good, total, drawn)]
    unit = (F.col("id") + 0.5) / n
    rows = spark.range(n).select("id", mixing.hypergeometric(*cols, unit).alias("x")).orderBy("id").collect()
    lo, p = hypergeometric_row(good, total, drawn)
    x, total_p = lo, p[0]
    for r in rows:
        u = (r["id"] + 0.5) / n
        while total_p < u - 1e-12 and x < lo + len(p) - 1:
            x += 1
            total_p += p[x - lo]
        assert abs(r["x"] - x) <= (1 if abs(total_p - u) < 1e-9 else 0)


def test_tree_adds_up(spark):
    quotas = {0: 17, 1: 0, 2: 1, 3: 500, 4: 33}
    frame = spark.createDataFrame(list(quotas.items()), "source_no int, blocks long")
    for shards in (1, 2, 7, 16):
        rows = {r["source_no"]: r["bounds"] for r in mixing.split_tree(frame, shards, 1).collect()}
        parts = {s: [b - a for a, b in zip([0, *ends], ends)] for s, ends in rows.items()}
        assert {s: sum(v) for s, v in parts.items()} == quotas
        assert all(n >= 0 for v in parts.values() for n in v)
        sums = [sum(v[j] for v in parts.values()) for j in range(shards)]
        assert sums == [551 * (j + 1) // shards - 551 * j // shards for j in range(shards)]


def test_odd_rows(spark, odd, docs_of):
    more = odd.withColumns({c: F.lit("x") for c in ("cell", "order", "target", "takes")})
    rows = mixing.mix(more).collect()
    assert len(rows) == 9
    assert all(r["size"] == 0 and r["takes"] == [] for r in rows if r["doc_id"] in (1, 2, 3))
    total = sum(r["size"] for r in rows)
    assert abs(sum(t["last"] - t["first"] for r in rows for t in r["takes"]) - 1.5 * total) <= 1
    assert mixing.mix(odd.limit(0)).collect() == []
    nothing = mixing.mix(docs_of([(1, "", None, "a"), (2, None, None, None)])).collect()
    assert [(r["target"], r["takes"]) for r in nothing] == [(0.0, []), (0.0, [])]


def test_null_source_comes_last(docs_of):
    rows = mixing.mix(docs_of([(1, "a " * 100, None, "z"), (2, "b " * 100, None, None), (3, "c " * 100, None, "a")])).collect()
    goal = {r["source"]: r["target"] for r in rows}
    expected = slow_targets({"z": 100, None: 100, "a": 100})
    assert goal == pytest.approx(expected)


def test_sizes_are_not_broadcast(docs_of):
    mixed = mixing.mix(docs_of([(i, "one two three", None, "s") for i in range(20)]))
    assert "SortMergeJoin" in mixed._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in mixed.collect()) == list(range(20))
