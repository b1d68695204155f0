import math
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardiolake.llm import langid, licences, lm
from cardiolake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


# --- language ID ----------------------------------------------------------------------------


def test_language_query_on_held_out_rows(spark):
    rows = QUERIES["op8_byte_cnn_language"](spark, FOLDER).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.96
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd, docs_of):
    train = docs_of(
        [(i, "the quick brown fox jumps over it", "en") for i in range(30)]
        + [(i, "der schnelle braune fuchs springt über ihn", "de") for i in range(30)]
    )
    net = langid.fit(train)
    more = odd.withColumns({c: F.lit("x") for c in ("lang_pred", "score", "h")})
    rows = langid.predict(more, net).collect()
    assert len(rows) == 9 and set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "h", "lang_pred", "score"}
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {1, 2, 3} and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert langid.label_texts(net, ["123 456 ###", "der fuchs", "the fox"])[0] == ["und", "de", "en"]
    assert langid.fit(docs_of([(1, "text", None)])) is None and langid.fit(train.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(odd.limit(0), net).collect() == []


def test_digits_are_no_letters(spark, docs_of):
    """Superscripts, fractions, circled and Roman numerals are numbers; letters of any script count."""
    rows = [(1, "²½ ① Ⅷ 12 _", "en"), (2, "日本", "xx"), (3, "ª", "en"), (4, "a plain text of words", "en"), (5, "und ein anderer Satz", "de")]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs_of(rows), F.col("lang").isNotNull()).collect()}
    assert found[1] == "und" and all(found[d] != "und" for d in (2, 3, 4, 5))


def test_windows_cover_the_whole_text():
    for n in (0, 1, 255, 256, 257, 1000, 5121):
        data = bytes(i % 251 for i in range(n))
        found = langid.windows_of(data)
        assert found.shape[1] == 256
        if n > 256:
            seen = set()
            for row in found:
                at = data.find(row.tobytes())
                seen.update(range(at, at + 256))
            assert found[-1].tobytes() == data[-256:] and len(found) == -(-n // 256)


# --- language model -------------------------------------------------------------------------


def test_base_scores_and_counts(spark, texts001):
    rows = QUERIES["op10_log_bilinear_scores"](spark, "/root/testdata/sf0.001").collect()
    words = {d: (t or "").encode().lower().split() for d, t in texts001.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    counts = Counter(w for d, ws in words.items() if not held[d] for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(words)
    for r in rows:
        tokens = [*words[r["doc_id"]], None]
        assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(tokens), n, held[r["doc_id"]])
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert r["score"] < 0
    mean = lambda key: np.mean([r[key] / r["n_tokens"] for r in rows if r["held_out"]])
    assert mean("score") > mean("base_score")


def test_probabilities_of_a_context_sum_to_one(docs_of):
    """After one and the same word, every known word and the unknown token share all probability."""
    learn = [(i, f"alpha beta gamma w{i} delta w{i % 7} alpha beta") for i in range(40)] + [(99, "only once here")]
    words = sorted({w for _, t in learn for w in t.split()})
    probes = [(1000 + i, f"alpha {w}") for i, w in enumerate([*words, "never-seen"])] + [(2000, "alpha")]
    shape = lm.Shape(frequent=3, groups=5, known=6, dim=4, batch=32)
    rows = lm.score(docs_of(learn + probes), F.col("doc_id") < 1000, shape=shape).collect()
    # P(alpha w end) = P(alpha) P(w | alpha) P(end | w alpha): ends differ, so compare by an outer sum
    score = {r["doc_id"]: r["score"] for r in rows}
    total = sum(10 ** score[1000 + i] for i in range(len(words) + 1))
    first = 10 ** score[2000]  # P(alpha) P(end | alpha)
    assert 0 < total < 1 and 0 < first < 1 and total + first < 1


@pytest.mark.parametrize("known", [1, 50, 500])
def test_equally_frequent_words_are_group_members(docs_of, known):
    """More words of the highest count than a task may hold: none is frequent, and shares stay shares."""
    learn = [(i, " ".join(f"w{(i * 10 + j) % 200}" for j in range(20))) for i in range(20)]
    probes = [(1000 + i, f"w{i}") for i in range(200)] + [(2000, "never-seen"), (2001, "")]
    shape = lm.Shape(frequent=20, groups=5, known=known, dim=4, batch=32)
    rows = lm.score(docs_of(learn + probes), F.col("doc_id") < 1000, shape=shape).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    # P(w end) of all words, the unknown token and nothing: parts of one.
    total = sum(10 ** score[d] for d in (*range(1000, 1200), 2000, 2001))
    assert 0 < total < 1 and all(v < 0 for v in score.values())
    assert {r["n_known"] for r in rows if 1000 <= r["doc_id"] < 1200} == {2}


def test_scorer_is_normalised():
    rng = np.random.default_rng(0)
    n, d = 30, 4
    w = lm.Weights(*(rng.normal(0, 1, s).astype(np.float32) for s in ((n, d), (n, d), (n,), (d, d), (d, d))))
    novel = np.concatenate([np.zeros(10), rng.uniform(0, 1, n - 10)])
    scorer = lm.Scorer(w, novel)
    for a, b in ((0, 0), (3, 7), (29, 12)):
        own, unknown = scorer.score(np.full(n, a), np.full(n, b), np.arange(n))
        p = 10.0**own
        assert p.sum() == pytest.approx(1, abs=1e-4)
        # known words of the classes and the one unknown token share all of it
        assert (p * (1 - novel)).sum() + 10.0 ** unknown[0] == pytest.approx(1, abs=1e-4)


def test_noise_contrastive_training_learns_a_context():
    shape = lm.Shape(frequent=4, groups=2, dim=4, batch=64, rate=0.2)
    stream = np.tile([1, 2, 3, 4], 4000)
    counts = np.array([1.0, 4000, 4000, 4000, 4000, 0, 0])
    vocabulary = lm.Vocabulary(shape, {}, np.zeros(1, np.int64), counts)
    trainer = lm.Trainer(vocabulary, 1)
    for low in range(2, len(stream) - 64, 64):
        trainer.step(stream[low - 1 : low + 63], stream[low - 2 : low + 62], stream[low : low + 64])
    own, _ = lm.Scorer(trainer.w, np.zeros(7)).score(np.array([1]), np.array([4]), np.array([2]))
    assert 10 ** own[0] > 0.6


def test_scores_of_odd_rows(odd):
    more = odd.withColumns({c: F.lit("x") for c in ("row", "word", "n", "score")})
    rows = lm.score(more, F.lit(True)).collect()
    assert len(rows) == 9 and all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (1, 2, 3))
    four = [r for r in rows if r["doc_id"] == 4]
    assert len(four) == 2 and four[0]["score"] == pytest.approx(four[1]["score"])
    unlearned = lm.score(odd, F.lit(False)).collect()
    assert len(unlearned) == 9 and all(r["score"] == r["base_score"] == r["n_known"] == 0 for r in unlearned)
    assert lm.score(odd.limit(0), F.lit(True)).collect() == []


def test_groups_agree_between_spark_and_python(spark):
    words = [b"a", b"ab", b"abc", b"abcd", "été".encode(), "日本".encode()]
    frame = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    rows = frame.select("word", (F.crc32(F.substring("word", -lm.SUFFIX, lm.SUFFIX)) % 127).alias("g")).collect()
    assert all(r["g"] == lm.group_of(bytes(r["word"]), 127) for r in rows)


# --- licences -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), negatives=600)


def test_licence_query_finds_the_notices_and_nothing_else(spark):
    rows = QUERIES["op7_licence_paragraphs"](spark, FOLDER).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(text)
    names = {"GNU General": "gpl-3.0", "Apache": "apache-2.0", "MIT": "mit", "CC BY-NC": "cc-by-nc", "All rights": "reserved"}
    for r in rows:
        lines = [x for x in text[r["doc_id"]].split("\n") if re.search(r"licen[sc]e|rights reserved", x, re.I)]
        expected = sorted({names[k] for x in lines for k in names if k in x})
        assert r["families"] == ",".join(expected)
        for x in r["licences"]:
            assert text[r["doc_id"]][x["start"] : x["stop"]] in lines and 0.5 <= x["probability"] <= 1 and x["likeness"] >= 0.5


@pytest.mark.parametrize(
    "line,family",
    [
        ("This file is licensed under the Apache License, Version 2.0 and nothing else.", "apache-2.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "mit"),
        ("// SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
        ("You can redistribute it under the terms of the license plate office.", None),
        ("My driver has a license to use the software version of the car.", None),
        ("All the rights in the world were reserved for public use.", None),
    ],
)
def test_licence_wordings(licence_model, line, family):
    found = licence_model.classify(line)
    assert (found[0] if found else None) == family


def test_licences_of_odd_rows(spark, odd, docs_of, licence_model):
    more = odd.withColumns({c: F.lit("x") for c in ("licences", "line", "start")})
    assert all(r["licences"] == [] for r in licences.scan(more, licence_model).collect())
    docs = docs_of([(1, "İ first\nAll rights reserved.\nend"), (2, "All rights reserved."), (2, "All rights reserved.")])
    rows = licences.scan(docs, licence_model).collect()
    assert [(x["start"], x["stop"]) for r in rows for x in r["licences"]] == [(8, 28), (0, 20), (0, 20)]
    assert licences.scan(odd.limit(0), licences.fit(odd.limit(0))).collect() == []


@pytest.mark.parametrize("mark,width", [("", 72), ("// ", 79), (" * ", 70), ("# ", 76), ("dnl ", 74)])
def test_wrapped_notices(docs_of, licence_model, mark, width):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    )
    gpl = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    )
    wrap = lambda x: textwrap.wrap(x, width, initial_indent=mark, subsequent_indent=mark)
    lines = ["int main;", "", *wrap("Copyright of the people who wrote this"), mark, *wrap(mit), mark, *wrap("It ends here."), *wrap(gpl), "int more;"]
    text = "\n".join(lines)
    found = licences.scan(docs_of([(1, text), (2, "\n".join(wrap(mit))), (3, "\n".join(wrap(gpl)))]), licence_model)
    rows = {r["doc_id"]: r["licences"] for r in found.collect()}
    assert [[x["family"] for x in rows[d]] for d in (1, 2, 3)] == [["mit", "gpl-3.0"], ["mit"], ["gpl-3.0"]]
    first, second = (text[x["start"] : x["stop"]] for x in rows[1])
    assert first.startswith(f"{mark}Permission is") and "copies of the" in first and first.split("\n") == [x for x in lines if x in first.split("\n")]
    assert second.split("\n") == wrap(gpl)
