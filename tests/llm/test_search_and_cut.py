import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cardiolake.llm import neighbours, substrings
from cardiolake.llm.queries import QUERIES

from test_fingerprints import slow_alike

# --- nearest neighbours ---------------------------------------------------------------------


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        own = x[ids.index(q)]
        d = sorted((float(np.sqrt(((v - own) ** 2).sum())), i) for i, v in zip(ids, x) if i != q)
        out[q] = d[:k]
    return out


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_neighbour_query_recall(spark, folder):
    folder = f"/root/testdata/{folder}"
    rows = QUERIES["op2_cross_polytope_neighbours"](spark, folder).collect()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in table], [np.array(r["embedding"], float) for r in table]
    expected = brute(ids, x, [i for i in ids if i % 100 == 0])
    place = dict(zip(ids, x))
    hits = 0
    for q, best in expected.items():
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11))
        assert all(s == np.sqrt(((place[v] - place[q]) ** 2).sum()) for _, v, s in own)
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        hits += len({v for _, v, _ in own} & {i for _, i in best})
    assert hits / (10 * len(expected)) >= 0.9


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(5, 64))
    y = neighbours.hadamard(x)
    assert np.allclose((x**2).sum(1), (y**2).sum(1)) and np.allclose(neighbours.hadamard(y), x)
    tables = neighbours.Tables(50, 2, 3)
    z = np.random.default_rng(2).normal(size=(4, 50))
    top = tables.buckets(z, 1, 128)
    assert top.shape == (4, 128) and np.array_equal(np.sort(top, axis=1), np.tile(np.arange(128), (4, 1)))
    y = tables.rotated(z, 1)
    assert all(top[i, 0] // 2 == np.abs(y[i]).argmax() for i in range(4))


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    some = [(i, rng.normal(size=8).tolist()) for i in range(5)]
    same = [(100 + i, [1.0] * 8) for i in range(40)]  # many equal vectors: ties go to the smaller ids
    bad = [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [float("inf")] * 8), (204, [None] + [1.0] * 7), (205, [1.0]), (None, [1.0] * 8), (206, [])]
    frame = spark.createDataFrame(some + same + bad + same[:3], "vec_id long, embedding array<double>")
    more = frame.withColumns({c: F.lit("x") for c in ("id", "vec", "tab", "bucket", "rank", "score")})
    rows = neighbours.search(more, F.col("vec_id").isin(100, 139, 200, 201, 0)).collect()
    by = {q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in rows}}
    assert set(by) == {0, 100, 139}
    assert by[100] == [(i, 100 + i, 0.0) for i in range(1, 11)]
    assert by[139] == [(i + 1, 100 + i, 0.0) for i in range(10)]
    few = neighbours.search(spark.createDataFrame(some, "vec_id long, embedding array<double>"), F.col("vec_id") == 2).collect()
    x = [np.array(v) for _, v in some]
    assert [(r["score"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == brute(list(range(5)), x, [2])[2]
    assert neighbours.search(frame.limit(0), F.lit(True)).collect() == []


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_BLOCK", 7)
    monkeypatch.setattr(neighbours, "_QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, (np.ones(8) + 0.01 * rng.normal(size=8)).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(frame, F.col("vec_id") % 6 == 0, k=4).collect()
    expected = brute([i for i, _ in rows], [np.array(v) for _, v in rows], range(0, 60, 6), 4)
    for q, best in expected.items():
        assert [(r["score"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == best


# --- substring dedup ------------------------------------------------------------------------


def slow_dedup(rows, min_words):
    """Units in order of (id, place); the first of each normalised text stays."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        gone = set()
        units = []
        for a, b in substrings.lines_of(text or ""):
            parts = substrings.sentences_of(text or "", a, b)
            units += ([(a, b)] if len(parts) > 1 else []) + parts
        for a, b in units:
            words = text[a:b].lower().split()
            if len(words) >= min_words:
                if " ".join(words) in seen:
                    gone.add((a, b))
        for a, b in units:
            words = text[a:b].lower().split()
            if len(words) >= min_words:
                where = [u for u in units if " ".join(text[u[0] : u[1]].lower().split()) == " ".join(words)]
                if (a, b) != min(where):
                    gone.add((a, b))
                seen.add(" ".join(words))
        out[d] = substrings.cut(text, gone, min_words)[0] if text else text
    return out


def test_dedup_query_equals_the_loop(spark, texts001):
    rows = QUERIES["op4_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    expected = slow_dedup(list(texts001.items()), substrings.MIN_WORDS)
    assert {r["doc_id"]: r["text"] for r in rows} == expected
    for r in rows:
        kept, at = [], 0
        for s in r["removed"]:
            kept.append(texts001[r["doc_id"]][at : s["start"]])
            at = s["stop"]
        assert "".join([*kept, texts001[r["doc_id"]][at:]]) == r["text"]


def test_passages_inside_lines_and_crumbs(docs_of):
    passage = "First of the sentences is long enough here. Yes. Second one is also quite long enough! Third and last of them ends it."
    docs = docs_of(
        [
            (1, "Intro words that nobody else has written.\n" + passage + "\nmore of one"),
            (2, "Another start of text in here. " + passage + " Tail words stay where they are."),
            (3, passage),
            (4, "  FIRST   of the sentences is\tlong enough here. "),
            (5, "Yes. Yes. Yes."),
        ]
    )
    rows = {r["doc_id"]: r for r in substrings.deduplicate(docs).collect()}
    assert rows[1]["removed"] == []
    assert rows[2]["text"] == "Another start of text in here. Tail words stay where they are."
    assert rows[3]["text"] == "" and [tuple(s) for s in rows[3]["removed"]] == [(0, len(passage))]
    assert rows[4]["text"].strip() == "" and rows[5]["text"] == "Yes. Yes. Yes."


def test_dedup_of_odd_rows(odd):
    more = odd.withColumns({c: F.lit("x") for c in ("id", "version", "start", "digest", "removed", "units", "c0")})
    rows = substrings.deduplicate(more).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r["text"] for r in rows}
    assert by[1] is None and by[2] == "" and by[5] == "" and by[4] == "same text here, twice over. And more of it follows."
    assert by[6].count("Lorem ipsum") == 1 and len(by[6]) < 60
    assert substrings.deduplicate(odd.limit(0)).collect() == []


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sf001):
    folder = "/root/testdata/sf0.001"
    docs, tables = sf001, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        tables.append(docs)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(t.columns == names for t in tables[:-1])
    start = {r["doc_id"]: r["text"] for r in sf001.collect()}
    known, single, cut, mixed, packed = ([r.asDict() for r in t.collect()] for t in tables)
    assert {r["doc_id"] for r in known} == {d for d, t in start.items() if re.search(r"[^\W\d_]", t)}
    groups, _ = slow_alike({r["doc_id"]: r["text"] for r in known}, words=5, least=0.8)
    assert {r["doc_id"] for r in single} == set(groups.values())
    expected = slow_dedup([(r["doc_id"], r["text"]) for r in single], substrings.MIN_WORDS)
    assert {r["doc_id"]: r["text"] for r in cut} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in [*cut, *mixed])
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows)
    assert abs(words(mixed) - 1.5 * words(cut)) <= 20
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    assert len(packed) == len({r["sequence_id"] for r in packed}) and sum(r["start"] == 0 for r in packed) == len(mixed)


def test_pipeline_on_odd_rows_and_nothing(spark, odd):
    docs = odd.withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") > 3, "s")})
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        docs.count()
        if name == "language ID":
            assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 4, 4, 5, 6, 7]
        if name == "SimHash near-dedup":
            assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 4, 6, 7]
    assert docs.count() > 0
    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        assert docs.count() == 0
