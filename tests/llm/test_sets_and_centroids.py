import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardiolake.llm import clustering, importance, jaccard
from cardiolake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


# --- centroid clustering --------------------------------------------------------------------------


def slow_clusters(vectors, k, rounds, scale, seed):
    """Every distance in every round, in whole numbers."""
    points = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in vectors]
    named = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in points)
    centroids = [x for _, x in named[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for turn in range(rounds + 1):
        found = [min((far(x, c), j) for j, c in enumerate(centroids)) for _, x in points]
        if turn == rounds:
            return [(i, j, d) for (i, _), (d, j) in zip(points, found)], centroids
        for j in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(points, found) if c == j]
            if own:
                centroids[j] = [sum(column) // len(own) for column in zip(*own)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_clusters_equal_the_loop(spark, seed):
    """Blobs, repeated and level vectors, ties between centroids, repeated and NULL ids."""
    rng = np.random.default_rng(seed)
    vectors = [(i, (rng.normal(size=3) + 4 * rng.integers(0, 4, 3)).tolist()) for i in range(150)]
    vectors += [(200 + i, [float(i % 3), 0.0, -1.0]) for i in range(30)] + [(7, [0.5, 0.5, 0.5]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    found = clustering.cluster(df, dim=3, k=6, rounds=7, scale=16, seed=seed)
    expected, centroids = slow_clusters(vectors, 6, 7, 16, seed)
    assert found.centroids == centroids
    assert ordered([tuple(r) for r in found.rows.collect()]) == ordered(expected)


def test_bounds_hold_and_spare_distances(monkeypatch):
    """Loosened bounds never exclude the true distance, and most centroids are ruled out by them."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(2000, 8)) * 20 + 400 * rng.integers(0, 5, (2000, 1))).astype(np.int64)
    history, bounds, asked = [x[:12].copy()], clustering.Bounds.nothing(2000, 12), []
    squared = clustering.squared
    monkeypatch.setattr(clustering, "squared", lambda a, c: asked.append(len(a)) or squared(a, c))
    for turn in range(12):
        asked.clear()
        past = np.array(history)
        bounds.assign(x, past)
        exact = np.stack([squared(x, c) for c in past[-1]], axis=1)
        assert (bounds.cluster == exact.argmin(axis=1)).all()
        moved = np.sqrt(((past - past[-1]).astype(float) ** 2).sum(axis=2))
        lower = bounds.lower - moved[bounds.asked, np.arange(12)]
        others = np.arange(12)[None, :] != bounds.cluster[:, None]
        assert (lower[others] <= np.sqrt(exact)[others] * (1 + 1e-9)).all()
        history.append(np.array([x[bounds.cluster == j].sum(axis=0) // max(1, (bounds.cluster == j).sum()) if (bounds.cluster == j).any() else past[-1][j] for j in range(12)]))
    assert sum(asked) < 0.4 * 2000 * 12


def test_vectors_that_take_no_part(spark):
    rows = [
        (1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]),
        (8, [float("inf"), 1.0]), (9, [0.0, 0.0]), (1, [1.0, 2.0]),
    ]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    found = clustering.with_inertia(clustering.cluster(df, dim=2, k=8, rounds=2)).collect()
    assert sorted(r["vec_id"] for r in found) == [1, 1, 9] and {r["distance"] for r in found} == {0}
    none = clustering.with_inertia(clustering.cluster(df.limit(0), dim=2))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), dim=1, k=1).rows.collect()


def test_clustering_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    expected, centroids = slow_clusters([(r["vec_id"], list(map(float, r["embedding"]))) for r in rows], 8, 10, 1024, 3)
    got = QUERIES["op11_ns_bounds_clustering"](spark, FOLDER).collect()
    assert ordered([(r["vec_id"], r["cluster"], r["distance"]) for r in got]) == ordered(expected)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    for r in got:
        assert r["centroid_sha256"] == names[r["cluster"]]
        assert r["inertia"] == sum(d for _, _, d in expected)
        assert r["cluster_inertia"] == sum(d for _, j, d in expected if j == r["cluster"])


# --- importance resampling -------------------------------------------------------------------------


def slow_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z":
            c = c.lower()
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 128:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def slow_resample(docs, target, percent, least, longest, buckets, seed):
    runs = lambda words: [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in runs(slow_words(text)):
                counts[bucket(f)] += 1
    S, T = sum(s), sum(t)
    rows = []
    for doc_id, text in docs:
        words = slow_words(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, runs(words)))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(runs(words)), weight, score, None, len(words)])
    long_ = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(long_[: len(long_) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 60)])
def test_resample_equals_the_loop(docs_of, odd, spark, longest, percent, monkeypatch):
    monkeypatch.setattr(importance, "_AT_ONCE", 64)  # texts in parts of 64 bytes
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Alpha", "beta", "GAMMA-1", "été", "x9", "日本語", "delta" * 30]) for _ in range(rng.randrange(60))) for _ in range(70)]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[1]), (-3, texts[2]), (1 << 62, texts[4]), (-(1 << 62), texts[4]), (90, None), (91, "")]
    target = spark.createDataFrame([("beta alpha x9",), (None,), ("日本語 beta",)], "text string").withColumn("score", F.lit(1))
    got = importance.resample(docs_of(rows), target, percent, 20, longest, 500, 7)
    expected = slow_resample(rows, ["beta alpha x9", None, "日本語 beta"], percent, 20, longest, 500, 7)
    assert by_id([tuple(r) for r in got.collect()]) == by_id(expected)
    assert importance.resample(odd, target).count() == odd.count()
    assert importance.resample(odd.limit(0), target.limit(0)).count() == 0


def test_resample_query(spark, sf001):
    target = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in sf001.collect()]
    got = QUERIES["op12_importance_resampling"](spark, FOLDER).collect()
    assert by_id([tuple(r) for r in got]) == by_id(slow_resample(docs, target, 10, 20, 1, 10_000, 2024))


@pytest.mark.parametrize("digit_bits,block", [(1, 4), (3, 16), (12, 1 << 16)])
def test_radix_ranks(spark, digit_bits, block):
    """Ties, negative and extreme numbers, NULL, one value for a third of the rows; any digit and block."""
    rng = random.Random(digit_bits)
    rows = [(i, rng.choice([5, 5, rng.randrange(-40, 40)]), rng.choice([None, rng.randrange(-9, 9)])) for i in range(120)]
    df = spark.createDataFrame(rows, "place long, a long, b long").repartition(3)
    got = importance.radix_ranks(df.withColumn("id", F.col("place")), [("a", True), ("b", False)], digit_bits, block).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 121))
    expected = sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[0]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [r[0] for r in expected]


def test_radix_ranks_of_extreme_numbers(spark):
    values = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, 1 << 40, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "place long, a long").withColumn("v", F.col("a"))
    for down in (False, True):
        got = [r["v"] for r in importance.radix_ranks(df, [("a", down)], 8).orderBy("rank").collect()]
        assert got == sorted(values[:-1], reverse=down) + [None]


# --- Jaccard join ----------------------------------------------------------------------------------


def slow_join(rows, words, percent):
    sets = []
    for _, text in rows:
        parts = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets.append({tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)} if len(parts) >= words else {tuple(parts)} - {()})
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        known = least.get(root(i))
        least[root(i)] = d if known is None else known if d is None else min(known, d)
    return [(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def families(seed, count, length, changes):
    """Texts with some words replaced: likeness around the threshold, short and long."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    out = []
    for _ in range(count):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(*length))]
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(changes)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            text = text[: len(text) - rng.randrange(3)]
            out.append(" ".join(text))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(
    "seed,count,length,changes,words,percent",
    [(1, 40, (4, 30), 3, 5, 80), (2, 25, (30, 200), 7, 5, 80), (3, 60, (2, 14), 3, 1, 80), (4, 30, (5, 60), 6, 2, 50), (5, 20, (5, 40), 2, 3, 100)],
)
def test_join_equals_all_pairs(docs_of, seed, count, length, changes, words, percent):
    rows = list(enumerate(families(seed, count, length, changes)))
    got = jaccard.join(docs_of(rows), words=words, percent=percent).collect()
    assert sorted(tuple(r) for r in got) == sorted(slow_join(rows, words, percent))


@pytest.mark.parametrize("scan,subsets", [(60, 24), (60, 0), (100_000, 0), (100_000, 12)])
def test_join_in_blocks_and_by_either_way(docs_of, monkeypatch, scan, subsets):
    """Cells cut into many blocks, no enumeration, and enumeration of all small sets give the same."""
    monkeypatch.setattr(jaccard, "_SCAN", scan)
    monkeypatch.setattr(jaccard, "boundary", lambda sets, percent: subsets)
    # One large family among small ones: a dense cell; a shared passage chains texts loosely.
    rng = random.Random(6)
    base = [f"b{i}" for i in range(40)]
    dense = [" ".join(w if rng.random() > 0.01 else f"c{rng.randrange(99)}" for w in base) for _ in range(60)]
    loose = [" ".join([f"l{i}x{j}" for j in range(6)] + base[:30] + [f"l{i + 1}x{j}" for j in range(6)]) for i in range(30)]
    rows = list(enumerate(dense + loose + families(7, 20, (4, 20), 2)))
    got = jaccard.join(docs_of(rows)).collect()
    assert sorted(tuple(r) for r in got) == sorted(slow_join(rows, 5, 80))


def test_join_of_odd_rows(docs_of, odd, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = jaccard.join(odd.withColumn("n", F.lit("clash")).withColumn("token", F.lit(1))).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted(slow_join(rows, 5, 80), key=key)
    assert jaccard.join(odd.limit(0)).count() == 0


def test_join_query(spark, sf001):
    rows = [(r["doc_id"], r["text"]) for r in sf001.collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_jaccard_join"](spark, FOLDER).collect()) == sorted(slow_join(rows, 5, 80))


def test_keys_of_small_sets():
    """A key for each partner size and subset; the count is what the cost model charges."""
    assert jaccard.least_common(10, 10, 80) == 9 and jaccard.least_common(4, 5, 80) == 4 and jaccard.least_common(3, 4, 80) == 4
    assert jaccard.subsets_of(10, 10, 10, 80) == 10 + 10 + 45  # nine of ten for sets of ten and of nine, eight for eight
    assert jaccard.subsets_of(10, 8, 10, 80) == 1  # eight shared ones: a partner of eight only
