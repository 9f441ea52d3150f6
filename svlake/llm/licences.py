"""Licence scanning: a trained paragraph classifier with a calibrated unknown class, confirmed against templates.

Lines of up to ``LONG`` words are paragraphs. Longer ones, and wrapped ones joined up to the next blank line, are read in
overlapping windows of 8 to 64 words, half a window apart, wherever they hold a template's word triple; so a notice is
found however much text stands around it. A multinomial logistic regression over sparse word 1- to 3-grams tells the licence families and
``unknown`` apart. It is trained from the templates below - whole, in parts, with words lost or replaced, beside other words -
and from a bounded sample of the corpus's own lines as unknown. Its temperature is set on rows kept out of training, and a
paragraph with less than the calibrated probability is unknown; that is calibrated on lines and on windows of each size. A prediction
counts if the paragraph also has enough of the word pairs of a template of that family.

N-grams that no template has carry no weight, so a paragraph without any of them is unknown without being scored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

WORD = re.compile(r"\w+")
UNKNOWN = "unknown"
LONG, WINDOWS = 64, (8, 16, 32, 64)

# Short licence notices and the best-known sentences of licence texts, by family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved. No part of this work may be reproduced without the prior written permission of the publisher.",
        "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
# Sentences that share words with licences and are none.
OTHERS = [
    "He got his driving license last week and will use it for work.",
    "The museum is free of charge for any person under eighteen.",
    "Permission to enter the building is granted by the office.",
    "The version of the software that was released in May is faster.",
    "The general public was not happy with the terms of the agreement.",
    "Copyright law protects the work of authors in most countries.",
    "You can obtain a copy of the report from the library at no cost.",
    "The foundation published its annual report under a new title.",
    "The source of the river and its course were both unknown.",
    "This file was not distributed with the others.",
]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _grams(w: list[str]) -> list[tuple[str, ...]]:
    return [tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _pairs(w: list[str]) -> frozenset:
    return frozenset(zip(w, w[1:], strict=False)) or frozenset((x,) for x in w)


class LicenceModel:
    """A sparse softmax regression and the templates' word pairs."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        self.templates = templates
        self.families = [*sorted(templates), UNKNOWN]
        self.pairs = {f: [_pairs(words(t)) for t in templates[f]] for f in sorted(templates)}
        self.grams: dict[tuple, int] = {}
        for f in sorted(templates):
            for t in templates[f]:
                for g in _grams(words(t)):
                    self.grams.setdefault(g, len(self.grams))
        self.triples = frozenset(g for g in self.grams if len(g) == 3)
        self.known_words = frozenset(g[0] for g in self.grams if len(g) == 1)
        self.weights = np.zeros((len(self.grams), len(self.families)))
        self.bias = np.zeros(len(self.families))
        self.temperature, self.least = 1.0, 0.5

    def features(self, w: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Known n-grams and their weight: the square root of a length-normalised count."""
        found: dict[int, int] = {}
        for g in _grams(w):
            if (i := self.grams.get(g)) is not None:
                found[i] = found.get(i, 0) + 1
        at = np.fromiter(found, int, len(found))
        return at, np.sqrt(np.fromiter(found.values(), float, len(found)) / max(1, len(w)))

    def logits(self, w: list[str]) -> np.ndarray:
        at, x = self.features(w)
        return x @ self.weights[at] + self.bias

    def probabilities(self, w: list[str]) -> np.ndarray:
        z = self.logits(w) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def closeness(self, w: list[str], family: str) -> float:
        """The largest share of a template's or the paragraph's word pairs, whichever has fewer, that both have."""
        mine = _pairs(w)
        return max((len(mine & t) / max(1, min(len(mine), len(t))) for t in self.pairs[family]), default=0.0)

    def similarity(self, w: list[str], family: str) -> float:
        return self.compare(w, family)[0]

    def compare(self, w: list[str], family: str) -> tuple[float, int, frozenset]:
        """Of the template that is closest: the share of its word pairs that the paragraph has, how many these are, and which. A few words of a
        template are a small share of it, so what only sounds like a notice isn't confirmed."""
        mine = _pairs(w)
        shared = [(len(both) / len(t), len(both), both) for t in self.pairs[family] if (both := mine & t)]
        return max(shared, key=lambda x: x[:2], default=(0.0, 0, frozenset()))

    def train(self, samples: list[tuple[list[str], int]], epochs: int = 30, rate: float = 0.1, decay: float = 1e-5, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        rows = [(*self.features(w), y) for w, y in samples]
        kept = rng.random(len(rows)) < 0.15
        fit, squares, bias_squares = np.flatnonzero(~kept), np.full_like(self.weights, 1e-8), np.full_like(self.bias, 1e-8)
        for _ in range(epochs):
            for i in rng.permutation(fit):
                at, x, y = rows[i]
                z = x @ self.weights[at] + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                g = x[:, None] * p + decay * self.weights[at]
                squares[at] += g * g
                bias_squares += p * p
                self.weights[at] -= rate * g / np.sqrt(squares[at])
                self.bias -= rate * p / np.sqrt(bias_squares)
        held = [samples[i] for i in np.flatnonzero(kept)] or samples
        z, y = np.array([self.logits(w) for w, _ in held]), np.array([y for _, y in held])

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        self.temperature = float(min(np.geomspace(0.2, 5, 41), key=loss))
        # The least probability at which at most 1 of 100 unknown paragraphs kept out of training would be named, and at most 1 of
        # 100 windows of each size over them, which is how longer texts are read.
        unknown = [w for w, k in held if k == len(self.families) - 1]
        flow = [x for w in unknown for x in w]
        kinds = [unknown, *([flow[i : i + n] for i in range(0, len(flow) - n + 1, n // 2)] for n in WINDOWS)]
        self.least = 0.5
        for paragraphs in kinds:
            tops = np.sort([self.probabilities(w)[:-1].max() for w in paragraphs if not self.known_words.isdisjoint(w)])
            if len(tops):
                self.least = max(self.least, float(tops[int(0.99 * (len(tops) - 1))]))


def samples_of(model: LicenceModel, lines: list[str], seed: int = 2, copies: int = 40) -> list[tuple[list[str], int]]:
    rng = np.random.default_rng(seed)
    other = [w for w in map(words, [*lines, *OTHERS]) if w and all(model.closeness(w, f) < 0.5 for f in model.pairs)]
    filler = [x for w in other for x in w] or ["text"]
    unknown, out = len(model.families) - 1, []
    for y, family in enumerate(model.families[:-1]):
        for t in model.templates[family]:
            w = words(t)
            out.append((w, y))
            for _ in range(copies):
                part = list(w)
                if len(w) > 12 and rng.random() < 0.5:
                    lo = rng.integers(0, len(w) // 2)
                    part = part[lo : lo + max(8, int(len(w) * rng.uniform(0.4, 1)))]
                part = [filler[rng.integers(len(filler))] if rng.random() < 0.04 else x for x in part if rng.random() > 0.04]
                part = [str(rng.integers(1, 5)) if x.isdigit() and rng.random() < 0.3 else x for x in part]
                pad = lambda: [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 6))]
                out.append((pad() + part + pad(), y))
            for _ in range(copies // 8):  # the same words without their order
                mixed = [w[i] for i in rng.permutation(len(w))]
                out.append((mixed + [filler[i] for i in rng.integers(0, len(filler), len(w))], unknown))
    out += [(w, unknown) for w in other for _ in range(1 if len(other) > 200 else 10)]
    return out


def blocks(lines: list[list[str]]) -> list[tuple[list[str], list[int]]]:
    """Runs of lines with words: all their words and the line of each."""
    out, run = [], []
    for n, w in enumerate([*lines, []]):
        if w:
            run.append(n)
        elif run:
            out.append(([x for k in run for x in lines[k]], [k for k in run for _ in lines[k]]))
            run = []
    return out


def stretches(model: LicenceModel, w: list[str], line: list[int]) -> list[tuple[int, int]]:
    """(from, to) of what is classified in a block: each line of up to ``LONG`` words with a word of a template and, unless the block is
    one such line, each window with a word triple of a template."""
    starts = [i for i in range(len(w)) if i == 0 or line[i] != line[i - 1]]
    out = [(i, j) for i, j in zip(starts, [*starts[1:], len(w)], strict=True) if j - i <= LONG and not model.known_words.isdisjoint(w[i:j])]
    if len(starts) > 1 or len(w) > LONG:
        at = [i for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if g in model.triples]
        wide = ((size, k) for size in WINDOWS for i in at for k in range(max(0, -(-(i + 3 - size) // (size // 2))), i // (size // 2) + 1))
        out += dict.fromkeys((k * (size // 2), min(len(w), k * (size // 2) + size)) for size, k in wide)
    return out


def named(model: LicenceModel, text: str | None) -> list[tuple[int, str, float, float]]:
    """(line, family, probability, similarity) of the notices in a text. Of named stretches whose words in common with a template
    overlap, that with the most pairs in common counts, the shorter of equals, and others of its family; a notice has the line where
    those words begin, and is reported once for each line and family with its best similarity."""
    best: dict[tuple[int, str], tuple[float, float]] = {}
    for w, line in blocks([words(x) for x in (text or "").splitlines()]):
        found = []
        for begin, end in stretches(model, w, line):
            part = w[begin:end]
            p = model.probabilities(part)
            k = int(p.argmax())
            if k < len(p) - 1 and p[k] >= model.least:
                share, n, both = model.compare(part, model.families[k])
                at = [i for i in range(begin, end - 1) if (w[i], w[i + 1]) in both]
                lo, hi = (at[0], at[-1] + 2) if at else (begin, end)
                found.append((-n, hi - lo, lo, hi, k + 1, share, float(p[k])))
        owner = np.zeros(len(w) if found else 0, np.int16)
        for _, _, lo, hi, k, share, p in sorted(found):
            if ((owner[lo:hi] == 0) | (owner[lo:hi] == k)).all():
                owner[lo:hi] = k
                key = line[lo], model.families[k - 1]
                best[key] = max(best.get(key, (share, p)), (share, p))
    return [(n, family, p, s) for (n, family), (s, p) in best.items()]


def _scan(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            out = [(doc_id, *x) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in named(model, text)]
            kinds = {"doc_id": pa.int64(), "paragraph": pa.int64(), "family": pa.string(), "probability": pa.float64(), "similarity": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds.values())], list(kinds))

    return run


def scan_licences(docs: DataFrame, confirm: float = 0.6, sample_docs: int = 1_000, sample_lines: int = 4_000, seed: int = 1) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of each line of ``docs`` (doc_id, text) at which the classifier
    names a family in the line or a window, one row for each family; lines count from 0, blank ones too. ``similarity`` is the share of a template's word pairs that stand there,
    ``confirmed`` says that it is at least ``confirm``.

    Unknown examples are the first ``sample_lines`` lines of at most ``sample_docs`` documents, in the order of a hash of
    doc_id. Null and empty texts have no lines; rows without doc_id are scanned as any other; repeated rows give repeated results;
    an empty table gives an empty result and a model trained from the templates alone."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = materialise(docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id")).limit(sample_docs), "sampled")
    lines = docs.join(F.broadcast(ids), "doc_id").select("doc_id", F.posexplode(F.split("text", r"\R")).alias("n", "line")).where("line <> ''")
    lines = [r.line for r in lines.orderBy(F.xxhash64("doc_id"), "doc_id", "n").limit(sample_lines).collect()]
    model = LicenceModel()
    model.train(samples_of(model, lines), seed=seed)
    found = docs.mapInArrow(_scan(spark.sparkContext.broadcast(model)), "doc_id long, paragraph long, family string, probability double, similarity double")
    return found.withColumn("confirmed", F.col("similarity") >= confirm)


def document_licences(docs: DataFrame, **options) -> DataFrame:
    """One row per doc_id with a named paragraph (null as one id; rows that share an id together; others have none): doc_id, families (of confirmed paragraphs, sorted, joined by commas), n_paragraphs, n_confirmed, probability (the largest)."""
    found = scan_licences(docs, **options)
    families = F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",")  # at most as many as there are families
    return found.groupBy("doc_id").agg(families.alias("families"), F.count("*").alias("n_paragraphs"), F.count_if("confirmed").alias("n_confirmed"), F.max("probability").alias("probability"))
