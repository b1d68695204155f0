"""Licence scans: a trained paragraph classifier over word n-grams, confirmed by templates."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_GAP = 12  # words between two triples of one notice
_COMMENT = frozenset(["dnl", "rem"])  # comment marks that are words; all others are no words at all
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
UNKNOWN = "unknown"

# Short public licence notices by family. Other wordings may be passed in.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "reserved": ("All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."),
}


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams_of(words: list[str]) -> list[str]:
    """Words, pairs and triples of words, repeats included."""
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:])), *(f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:]))]


@dataclass
class Model:
    """Logistic regression over the n-grams of the templates, one class per family and ``unknown``."""

    labels: list[str]  # the last one is unknown
    index: dict[str, int]
    weights: np.ndarray  # (n-grams + 2, labels): the last two are length and the share of other words
    bias: np.ndarray
    heat: float  # probabilities are softmax(score / heat): fitted on held-out paragraphs
    least: float  # below this probability a family is not accepted
    telling: frozenset[str]  # words without which no paragraph is examined
    templates: dict[str, list[frozenset[str]]]

    @cached_property
    def places(self) -> dict[str, list[tuple[str, int]]]:
        """The templates, as (family, number), that hold a triple."""
        out = defaultdict(list)
        for family, all_triples in self.templates.items():
            for k, triples in enumerate(all_triples):
                for triple in triples:
                    out[triple].append((family, k))
        return dict(out)

    def row(self, words: list[str]) -> np.ndarray:
        x = np.zeros(len(self.weights), np.float32)
        get = self.index.get
        for g in grams_of(words):
            i = get(g)
            if i is not None:
                x[i] += 1
        seen = sum(1 for w in words if w in self.index)
        n = max(len(words), 1)
        x[:-2] /= np.sqrt(n)
        x[-2], x[-1] = np.log1p(n) / 4, 1 - seen / n
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.heat
        p = np.exp(z - z.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)

    def classify(self, paragraph: str) -> tuple[str, float, float] | None:
        """(family, calibrated probability, likeness to its nearest template), or None.

        The classifier proposes a family; it counts if its probability reaches the calibrated limit
        and half of the word triples of some template of the family stand in the paragraph.
        """
        words = words_of(paragraph)
        if not self.telling.intersection(words):
            return None
        p = self.probabilities(self.row(words))
        best = int(p.argmax())
        if best == len(self.labels) - 1 or p[best] < self.least:
            return None
        own = triples_of(words)
        near = max(len(own & t) / len(t) for t in self.templates[self.labels[best]])
        return (self.labels[best], float(p[best]), near) if near >= 0.5 else None


def triples_of(words: list[str]) -> frozenset[str]:
    if len(words) < 3:
        return frozenset([" ".join(words)])
    return frozenset(" ".join(words[i : i + 3]) for i in range(len(words) - 2))


def train(negatives: list[str], templates: dict[str, tuple[str, ...]] | None = None, seed: int = 5, copies: int = 60) -> Model:
    """Fit on varied templates against paragraphs of the corpus.

    Templates are varied by dropping words and by adding words of ordinary paragraphs before and
    after. Unknown paragraphs are the negatives and mixtures of scattered template words and others. A
    third of the rows is held out: the heat is chosen to fit their probabilities, the limit (0.5 to
    0.9) to reject the held-out unknown rows.
    """
    templates = templates or TEMPLATES
    rng = np.random.default_rng(seed)
    labels = [*sorted(templates), UNKNOWN]
    plain = [words_of(n) for n in negatives]
    plain = [w for w in plain if w] or [["text"]]
    filler = [w for words in plain for w in words]
    some = lambda n: [filler[i] for i in rng.integers(0, len(filler), n)]
    rows: list[list[str]] = []
    target: list[int] = []
    everything = [words_of(t) for texts in templates.values() for t in texts]
    for c, label in enumerate(labels[:-1]):
        for text in templates[label]:
            words = words_of(text)
            for i in range(copies):
                kept = [w for w in words if i == 0 or rng.random() > 0.04] or words
                before = some(rng.integers(0, 8)) if i % 3 == 1 else []
                after = some(rng.integers(0, 30)) if i % 3 == 2 else []
                rows.append([*before, *kept, *after])
                target.append(c)
    unknown = len(labels) - 1
    rows += plain
    target += [unknown] * len(plain)
    for _ in range(20 * len(everything)):
        words = everything[rng.integers(len(everything))]
        few = [words[i] for i in rng.permutation(len(words))[: rng.integers(1, 4)]]
        mixed = [*few, *some(rng.integers(4, 30))]
        rows.append([mixed[i] for i in rng.permutation(len(mixed))])
        target.append(unknown)
    grams = sorted({g for t in everything for g in grams_of(t)})
    counts: dict[str, int] = {}
    for words in plain:
        for w in set(words):
            counts[w] = counts.get(w, 0) + 1
    # Words of templates that fewer than one in fifty ordinary paragraphs hold.
    telling = {w for t in everything for w in t if counts.get(w, 0) * 50 <= len(plain)}
    model = Model(
        labels,
        {g: i for i, g in enumerate(grams)},
        np.zeros((len(grams) + 2, len(labels))),
        np.zeros(len(labels)),
        1.0,
        0.5,
        frozenset(telling),
        {k: [triples_of(words_of(t)) for t in texts] for k, texts in templates.items()},
    )
    x = np.array([model.row(r) for r in rows])
    y = np.array(target)
    held = rng.random(len(y)) < 1 / 3
    fit, one = ~held, np.eye(len(labels))[y]
    g2w, g2b = np.full(model.weights.shape, 1e-6), np.full(model.bias.shape, 1e-6)
    for _ in range(50):
        order = rng.permutation(np.flatnonzero(fit))
        for low in range(0, len(order), 256):
            i = order[low : low + 256]
            d = (model.probabilities(x[i]) - one[i]) / len(i)
            gw, gb = x[i].T @ d + 1e-5 * model.weights, d.sum(0)
            g2w += gw * gw
            g2b += gb * gb
            model.weights -= 0.2 * gw / np.sqrt(g2w)
            model.bias -= 0.2 * gb / np.sqrt(g2b)
    best = np.inf
    chosen = 1.0
    for heat in np.geomspace(0.25, 4, 17):
        model.heat = float(heat)
        p = model.probabilities(x[held])
        loss = -np.log(np.maximum(p[np.arange(len(p)), y[held]], 1e-12)).mean()
        if loss < best:
            best, chosen = loss, float(heat)
    model.heat = chosen
    p = model.probabilities(x[held])
    wrong = p[y[held] == unknown][:, :-1].max(initial=0.0)
    model.least = float(min(0.9, max(0.5, wrong)))
    return model


def fit(docs: DataFrame, text_col: str = "text", negatives: int = 3000, templates: dict | None = None) -> Model:
    """Train against a bounded sample of paragraphs: about ``negatives`` of them, one a document.

    Documents are chosen by a hash of their text, at a rate that follows from their number, and give
    a paragraph of at most 600 characters without a word on licences.
    """
    rows = docs.select(F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    n = rows.count()
    share = min(1.0, 2 * negatives / max(n, 1))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(9), "text"), 11).cast("double") / F.lit(float(1 << 53))
    lines = F.split("text", "\n")
    line = F.get(lines, F.pmod(F.xxhash64("text"), F.size(lines)).cast("int"))
    picked = (
        rows.filter(unit < share)
        .select(F.substring(line, 1, 600).alias("line"))
        .filter(~F.lower("line").rlike("licen[sc]|copyright|rights|permission|permitted|redistribut|spdx|creative commons"))
        .limit(negatives)
        .collect()
    )
    return train(sorted(r["line"] for r in picked), templates)


def scan(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, licences) of every row: the lines and paragraphs that hold a licence notice.

    ``licences`` lists (start, stop, family, probability, likeness) of a line, or of the consecutive
    lines over which a notice is wrapped, comment marks aside, by code points of the whole text; it is empty for NULL or empty texts and texts without notices. Repeated rows give
    repeated results; other columns are ignored; no rows give none. No shuffle: a task examines lines
    that hold a telling word (one of a template that ordinary paragraphs lack).
    """
    found_type = T.ArrayType(
        T.StructType(
            [
                T.StructField("start", T.LongType()),
                T.StructField("stop", T.LongType()),
                T.StructField("family", T.StringType()),
                T.StructField("probability", T.DoubleType()),
                T.StructField("likeness", T.DoubleType()),
            ]
        )
    )
    schema = T.StructType([docs.schema[id_col], T.StructField("licences", found_type)])
    screen = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, model.telling), key=len, reverse=True)) + r")(?![^\W_])")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct(
                [("start", pa.int64()), ("stop", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())]
            )
        )
        for batch in batches:
            out = [notices(model, screen, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def notices(model: Model, screen: re.Pattern, text: str | None) -> list[dict]:
    """The licence notices of one text: single lines, and notices that run over lines of a paragraph."""
    text = text or ""
    out, past = [], -1
    found = [(a, b, model.classify(text[a:b])) for a, b in _lines(text, text.lower(), screen)]
    lines = {a: (a, b, got[0], got[1], got[2]) for a, b, got in found if got}
    for start, _, _ in found:
        if start < past:
            continue
        paragraph = _paragraph(text, start)
        past = paragraph[-1][1] + 1
        for first, last, parts, got in _wrapped(model, text, paragraph):
            hit = [i for i in range(first, last + 1) if lines.get(paragraph[i][0], " " * 3)[2] == got[0]]
            if parts - set(hit):
                for i in hit:
                    del lines[paragraph[i][0]]
                out.append((paragraph[first][0], paragraph[last][1], *got))
    names = ("start", "stop", "family", "probability", "likeness")
    return [dict(zip(names, x)) for x in sorted([*lines.values(), *out])]


def _paragraph(text: str, start: int) -> list[tuple[int, int]]:
    """The consecutive lines with words around the line that begins at ``start``."""
    end = text.find("\n", start)
    own = (start, len(text) if end < 0 else end)
    before, after = [], []
    at = start
    while at > 0:
        low = text.rfind("\n", 0, at - 1) + 1
        if not _WORD.search(text, low, at - 1):
            break
        before.append((low, at - 1))
        at = low
    at = own[1] + 1
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if not _WORD.search(text, at, end):
            break
        after.append((at, end))
        at = end + 1
    return [*reversed(before), own, *after]


def _wrapped(
    model: Model, text: str, paragraph: list[tuple[int, int]]
) -> list[tuple[int, int, set[int], tuple[str, float, float]]]:
    """(first line, last line, lines with triples of its template, class) of notices over several lines.

    Where triples of one template follow each other closely and make half of it, the words from the
    first to the last of them are classified like a line. Of overlapping notices the likest stays.
    """
    if len(paragraph) < 2:
        return []
    words: list[str] = []
    line: list[int] = []
    for i, (a, b) in enumerate(paragraph):
        own = words_of(text[a:b])
        own = own[1:] if own[0] in _COMMENT else own
        words += own
        line += [i] * len(own)
    hits: dict[tuple[str, int], list[tuple[int, str]]] = defaultdict(list)
    for at, three in enumerate(zip(words, words[1:], words[2:])):
        triple = " ".join(three)
        for key in model.places.get(triple, ()):
            hits[key].append((at, triple))
    found = []
    for (family, k), places in hits.items():
        size = len(model.templates[family][k])
        low = 0
        for high in range(1, len(places) + 1):
            if high < len(places) and places[high][0] - places[high - 1][0] <= _GAP:
                continue
            group, low = places[low:high], high
            first, last = group[0][0], group[-1][0] + 2
            if 2 * len({t for _, t in group}) < size or line[first] == line[last]:
                continue
            got = model.classify(" ".join(words[first : last + 1]))
            if got and got[0] == family:
                found.append((line[first], line[last], {line[at + j] for at, _ in group for j in range(3)}, got))
    kept = []
    for x in sorted(found, key=lambda x: (-x[3][2], x[0] - x[1], x[0])):
        if all(x[1] < y[0] or y[1] < x[0] for y in kept):
            kept.append(x)
    return kept


def _lines(text: str, low: str, screen: re.Pattern) -> Iterator[tuple[int, int]]:
    """Lines of ``text`` that hold a telling word."""
    if len(low) != len(text):  # lower case changed the length: offsets differ, go line by line
        at = 0
        while at <= len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            if screen.search(text[at:end].lower()):
                yield at, end
            at = end + 1
        return
    pos = 0
    while m := screen.search(low, pos):
        start = low.rfind("\n", 0, m.start()) + 1
        end = low.find("\n", m.end())
        end = len(low) if end < 0 else end
        yield start, end
        pos = end
