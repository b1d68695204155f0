import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cardiolake.llm import jaccard, shared, simhash, syncmers
from cardiolake.llm.shared import components, position
from cardiolake.llm.queries import QUERIES


def slow_syncmers(data, k, s):
    """Anchors by the definition: the least s-mer hash of a k-mer lies at an edge."""
    out = []
    for i in range(len(data) - k + 1):
        inner = [data[i + j : i + j + s] for j in range(k - s + 1)]
        h = [int(syncmers._mix(np.array([int.from_bytes(x, "little")], np.uint64) * syncmers._M2)[0]) for x in inner]
        if min(h) in (h[0], h[-1]):
            out.append(i)
    return out


def test_syncmers_by_definition(texts001):
    for k, s in ((16, 8), (16, 5), (12, 3), (9, 8), (8, 1)):
        for text in ["abcdefgh" * 5, "x" * 40, *list(texts001.values())[:3]]:
            data = text.encode()[:300]
            at, value = syncmers.syncmers(data, k, s)
            assert at.tolist() == slow_syncmers(data, k, s)
            assert len(value) == len(at)


def test_anchors_do_not_depend_on_their_surroundings():
    core = b"The quick brown fox jumps over the lazy dog and runs into the deep dark forest."
    at, value = syncmers.syncmers(core)
    moved, other = syncmers.syncmers(b"something before " + core + b" and after")
    found = dict(zip(moved.tolist(), other.tolist()))
    assert len(at) > 5 and all(found[a + 17] == v for a, v in zip(at.tolist(), value.tolist()))


def test_short_and_empty():
    assert len(syncmers.sketch(b"")) == 0 and syncmers.likeness(syncmers.sketch(b""), syncmers.sketch(b"")) == 1.0
    assert len(syncmers.sketch(b"tiny")) == 1
    assert syncmers.likeness(syncmers.sketch(b"tiny"), syncmers.sketch(b"tiny")) == 1.0
    assert syncmers.likeness(syncmers.sketch(b"tiny"), syncmers.sketch(b"")) == 0.0


def test_every_short_text_has_an_anchor():
    rng = random.Random(1)
    for n in range(1, 31):
        texts = {bytes(rng.choices(b"abcdefghijklmnop ", k=n)) for _ in range(60)}
        prints = [syncmers.sketch(x) for x in texts]
        assert all(len(p) for p in prints)
        assert all(syncmers.likeness(p, syncmers.sketch(b"")) == 0.0 and syncmers.likeness(p, p) == 1.0 for p in prints)
        if 4 < n < 17:
            assert len({p.tobytes() for p in prints}) == len(texts)


def check_fingerprints(rows, source):
    order = sorted(source, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = []
    for i, (key, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = (text[: len(text) - cut] + following[:cut]).encode()
        own, other, nxt = (syncmers.sketch(x) for x in (text.encode(), edited, following.encode()))
        expected.append(
            (
                key, len(text), hashlib.sha256(edited).hexdigest(), syncmers.as_text(own), syncmers.as_text(other),
                syncmers.likeness(own, other), syncmers.likeness(own, nxt),
            )
        )
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)


def test_fingerprint_query(spark, texts001):
    rows = QUERIES["op1_syncmer_fingerprints"](spark, "/root/testdata/sf0.001").collect()
    check_fingerprints(rows, list(texts001.items()))
    assert np.mean([r["near_edited"] for r in rows]) > 0.5 > 0.05 > np.mean([r["near_next"] for r in rows])


def test_fingerprints_of_odd_rows(odd, docs_of):
    more = odd.withColumns({c: F.lit(1) for c in ("key", "bucket", "guest", "fingerprint")})
    check_fingerprints(syncmers.fingerprints(more).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    one = docs_of([(7, "only one document here, followed by itself")])
    check_fingerprints(syncmers.fingerprints(one).collect(), [(7, "only one document here, followed by itself")])
    assert syncmers.fingerprints(odd.limit(0)).collect() == []


def test_anchor_rows(odd):
    rows = syncmers.anchors(odd).collect()
    assert {r["doc_id"] for r in rows} == {3, 4, 5, 6, 7, None}
    same = {d: sorted((r["position"], r["anchor"]) for r in rows if r["doc_id"] == d) for d in (4, 5)}
    assert sorted(same[5] * 2) == same[4]


def test_position_is_a_binary_search(spark):
    for cuts in ([], [5], [1, 4, 9], list(range(0, 70, 3))):
        rows = spark.range(-2, 75).select("id", position(cuts, F.col("id")).alias("p")).collect()
        assert all(r["p"] == sum(c <= r["id"] for c in cuts) for r in rows)
    assert spark.sql("select cast(null as bigint) as id").select(position([1, 2], F.col("id"))).first()[0] == 0


# --- SimHash --------------------------------------------------------------------------------


def slow_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def slow_groups(prints, radius=4):
    """Least reachable id by comparing all pairs; prints: (id, fp)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{fp:016x}", least[find(i)]) for i, (d, fp) in enumerate(prints)]


def test_simhash_by_definition(texts001):
    many = " ".join(texts001.values())
    for text in [None, "", "a", "A b", "x  Y\tz w v", many, *list(texts001.values())[:25]]:
        assert simhash.simhash(text) == slow_simhash(text)


def test_group_query_equals_all_pairs(spark, texts001):
    rows = QUERIES["op5_simhash_groups"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, rows)) == sorted(slow_groups([(d, slow_simhash(t)) for d, t in texts001.items()]))


def test_links_lose_none_and_add_none(spark):
    """Chains at every distance up to 6, at random places, and far fingerprints."""
    rng = random.Random(4)
    prints = []
    for d in range(60):
        base = rng.getrandbits(64)
        prints.append(base)
        for step in rng.sample(range(1, 7), 3):
            base ^= sum(1 << b for b in rng.sample(range(64), step))
            prints.append(base)
    distinct = spark.createDataFrame([(simhash._signed(p),) for p in set(prints)], "fp long")
    kept = {r["fp"] for r in simhash.candidates(distinct, 4).collect()}
    near = {simhash._signed(a) for a in prints for b in prints if a != b and bin(a ^ b).count("1") <= 4}
    assert near <= kept
    found = components(simhash.links(distinct, 4))
    root = {r["node"]: r["root"] for r in found.collect()}
    expected = slow_groups(list(enumerate(prints)))
    by_root, by_group = {}, {}
    for (i, _, group), p in zip(expected, prints):
        by_root.setdefault(root.get(simhash._signed(p), p), set()).add(p)
        by_group.setdefault(group, set()).add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_group.values()))


def test_groups_of_odd_rows(odd):
    more = odd.withColumns({c: F.lit("x") for c in ("fp", "least", "root", "component_id")})
    rows = sorted(simhash.groups(more).collect(), key=lambda r: (r["doc_id"] or 0, r["fingerprint"]))
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 9
    assert by[1]["fingerprint"] == "0" * 16 and {by[d]["component_id"] for d in (1, 2, 3)} == {1}
    assert by[4]["component_id"] == by[5]["component_id"] == 4 and by[6]["component_id"] == 6
    assert by[None]["component_id"] is None
    assert simhash.groups(odd.limit(0)).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5000), (None, 3)]
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    roots = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(roots) == 301
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[1000 + i] for i in range(100)}) == 1
    assert roots[0] != roots[1000]
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# --- groups by similarity -------------------------------------------------------------------


def slow_alike(texts, words=5, least=0.8):
    """Least reachable id and all pairs below equality, by comparing shingle sets over an index."""
    sets = {}
    for d, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[d] = {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    holders = {}
    for d in sorted(sets):
        for s in sets[d] or {None}:
            holders.setdefault(s, []).append(d)
    root, pairs = {d: d for d in sets}, []

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d in sorted(sets):
        common = {}
        for s in sets[d] or {None}:
            for e in holders[s]:
                if e < d:
                    common[e] = common.get(e, 0) + 1
        for e, c in common.items():
            if sets[d] == sets[e] or c / (len(sets[d]) + len(sets[e]) - c) >= least:
                pairs += [(e, d)] if sets[d] != sets[e] else []
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}, pairs


def test_alike_groups_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    expected, pairs = slow_alike(texts)
    found = {r["doc_id"]: r["component_id"] for r in simhash.alike(docs).collect()}
    far = [(a, b) for a, b in pairs if bin(slow_simhash(texts[a]) ^ slow_simhash(texts[b])).count("1") > 4]
    assert far and all(found[a] == found[b] for a, b in far)
    assert found == expected


def test_alike_finds_edited_copies_and_no_others(docs_of):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        near, far = list(words), list(words)
        for at in rng.sample(range(10, 290), 5):
            near[at] = "edited"
        for at in range(10, 290, 20):
            far[at] = "changed"
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(near)), (10 * i + 2, " ".join(far))]
    found = {r["doc_id"]: r["component_id"] for r in simhash.alike(docs_of(rows)).collect()}
    assert found == slow_alike(dict(rows))[0] and all(found[10 * i + 1] == 10 * i for i in range(60))
    assert len(set(found.values())) == 120


def test_alike_of_odd_rows(odd):
    more = odd.withColumns({c: F.lit("x") for c in ("node", "n", "low", "bits", "component_id", "version")})
    rows = simhash.alike(more).collect()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == 9 and by == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, None: None}
    assert simhash.alike(odd.limit(0)).collect() == []


def test_close_cells_do_not_depend_on_the_number_of_nodes(spark, monkeypatch):
    """Two nodes are together or not whatever number of others is reported beside them."""
    flips = [0, 1, 24] + [29 * i + k for i in range(1, 32) for k in (0, 9, 20)]
    words = [sum(1 << p % 64 for p in flips if p // 64 == w) for w in range(simhash.PLANES)]
    far = [v - (1 << 64) if v >> 63 else v for v in words]
    near = spark.createDataFrame([(1, [0] * 16), (2, far), (3, [0] * 15 + [3])], "node long, bits array<long>")
    cells = lambda: sorted(r["node"] for r in simhash.close_cells(near).collect())
    few = cells()
    monkeypatch.setattr(type(near), "count", lambda self: 1 << 20)
    assert cells() == few and {1, 3} <= set(few)
    assert simhash.PRINTS * simhash.WIDTH <= simhash.PLANES * simhash.BITS


def plans_of_written(monkeypatch, *modules):
    """{table: plan as first made}, filled in as the modules write their tables."""
    plans, write = {}, shared.written

    def written(df, name="table", path=None):
        plan = df._jdf.queryExecution().executedPlan().toString()
        plans[name if path is None else path.rpartition("/")[2].rpartition("-")[0]] = plan
        return write(df, name, path)

    for module in modules:
        monkeypatch.setattr(module, "written", written)
    return plans


def test_alike_broadcasts_no_table_that_spark_sizes_too_low(docs_of, monkeypatch):
    plans = plans_of_written(monkeypatch, simhash, jaccard)
    rng = random.Random(8)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(20)]
    rows = [(2 * i + j, " ".join(w[: 60 - j])) for i, w in enumerate(words) for j in (0, 1)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.alike(docs_of(rows)).collect()}
    assert found == {i: i - i % 2 for i, _ in rows}
    # Keys and shingles come of an explode, the others are one row a document or more.
    for name in ("alike-met", "alike-few", "alike-near", "jaccard-open", "jaccard-shared", "jaccard-sets"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name], name


def test_components_merge_maps_of_many_nodes(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    table = spark.createDataFrame(edges, "u long, v long")

    def grouped():
        members = {}
        for r in components(table).collect():
            members.setdefault(r["root"], set()).add(r["node"])
        return sorted(map(sorted, members.values()))

    few = grouped()
    monkeypatch.setattr(shared, "_BROADCAST_ROWS", 0)
    plans = plans_of_written(monkeypatch, shared)
    assert grouped() == few and len(few) > 20
    assert plans["links"].count("SortMergeJoin") == 2 and "Broadcast" not in plans["links"]
