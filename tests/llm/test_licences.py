from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from svlake.llm import licences as L

CLEAN = ["The river was wide and the boats were slow", "Licence to drive a car in most towns", "A note about public parks and software"]


def test_names_families_and_leaves_clean_text(spark):
    docs = [(i, f"some prose here.\n{t}\nmore prose") for i, t in enumerate(x for f in sorted(L.TEMPLATES) for x in L.TEMPLATES[f])]
    family = [f for f in sorted(L.TEMPLATES) for _ in L.TEMPLATES[f]]
    docs += [(1000 + i, t) for i, t in enumerate(CLEAN)] + [(2000, None), (2001, ""), (None, "Released under the MIT License."), (2002, "Released under the MIT License!!! \n" + "x " * 50_000)]
    got = L.scan_licences(spark.createDataFrame(docs, "doc_id long, text string")).where("confirmed").collect()
    by = {(r.doc_id, r.paragraph): r.family for r in got}
    assert sum(by.get((i, 1)) == f for i, f in enumerate(family)) >= 0.95 * len(family)
    assert not [k for k in by if k[0] in (1000, 1001, 1002, 2000, 2001)]
    assert by[None, 0] == "mit"
    assert by[2002, 0] == "mit"
    assert all(0.5 <= r.probability <= 1 for r in got)


PROSE = ["der Tag war lang und die Nacht kurz", "the boats on the wide river were slow that day", "un texto sin nada que decir"]


def test_notices_in_long_and_wrapped_lines(spark):
    """A notice amid any number of words of one line, and notices broken over lines, with comment marks."""
    fill = lambda n: " ".join((" ".join(PROSE).split() * (n // 20 + 1))[:n])
    grant, docs, want = L.TEMPLATES["mit"][0], [], {}
    for t, family in (("Released under the MIT License.", "mit"), (grant, "mit"), (L.TEMPLATES["gpl"][0], "gpl"), (L.TEMPLATES["mpl"][0], "mpl")):
        for n in (0, 5, 65, 260, 1300, 20_000):
            want[len(docs)] = family
            docs.append(f"{fill(n)} {t} {fill(n // 2)}")
    for t, family in ((grant, "mit"), (L.TEMPLATES["apache"][1], "apache"), (L.TEMPLATES["isc"][0], "isc")):
        w = t.split()
        want[len(docs)] = family
        docs.append("intro\n\n" + "\n".join("# " + " ".join(w[i : i + 5]) for i in range(0, len(w), 5)) + "\n\n" + fill(50))
    want |= {len(docs) + i: None for i in range(2)}
    docs += [fill(5000), "\n".join(PROSE * 50)]
    rows = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(docs)], "doc_id long, text string, family string, probability double")
    got = {r.doc_id: r.families for r in L.document_licences(rows).where("n_confirmed > 0").collect()}
    assert {i: got.get(i) for i in want} == want


def test_scan_equals_scoring_by_hand(spark, sf_dir):
    """Every line and window of whole texts, scored with dictionaries and exp alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = L.LicenceModel()
    lines = [line for r in docs.limit(100).collect() for line in (r.text or "").splitlines() if line][:600]
    model.train(L.samples_of(model, lines))
    position = {g: i for i, g in enumerate(model.grams)}

    def score(w):
        counts = Counter(g for n in (1, 2, 3) for g in zip(*[w[k:] for k in range(n)], strict=False) if g in position)
        z = [float(model.bias[f]) + sum(math.sqrt(c / len(w)) * float(model.weights[position[g], f]) for g, c in counts.items()) for f in range(len(model.families))]
        e = [math.exp(v / model.temperature - max(z) / model.temperature) for v in z]
        return [v / sum(e) for v in e]

    mixed = [f"{'words of prose ' * 40}{t} {'and more of it ' * 40}" for f in ("mit", "bsd") for t in L.TEMPLATES[f]]
    for text in [*(r.text for r in docs.where("text rlike '(?i)licen'").limit(25).collect()), *mixed]:
        want = {}
        cut = [re.findall(r"\w+", line.lower()) for line in text.splitlines()]
        runs, n = [], 0
        while n < len(cut):
            if not cut[n]:
                n += 1
                continue
            m = n
            while m < len(cut) and cut[m]:
                m += 1
            runs.append(range(n, m))
            n = m
        for run in runs:
            block = [(x, k) for k in run for x in cut[k]]
            flat, tries, at = [x for x, _ in block], [], 0
            for k in run:
                if len(cut[k]) <= 64 and any((x,) in position for x in cut[k]):
                    tries.append((at, at + len(cut[k])))
                at += len(cut[k])
            for size in (8, 16, 32, 64):
                for begin in range(0, len(flat), size // 2):
                    end = min(len(flat), begin + size)
                    if (len(run) > 1 or len(flat) > 64) and any(tuple(flat[i : i + 3]) in position for i in range(begin, end - 2)):
                        tries.append((begin, end))
            found = set()
            for begin, end in tries:
                p = score(flat[begin:end])
                k = p.index(max(p))
                if k < len(p) - 1 and p[k] >= model.least:
                    share, pairs, both = model.compare(flat[begin:end], model.families[k])
                    hits = [i for i in range(begin, end - 1) if (flat[i], flat[i + 1]) in both]
                    lo, hi = (hits[0], hits[-1] + 2) if hits else (begin, end)
                    found.add((-pairs, hi - lo, lo, hi, k, share, round(p[k], 12)))
            kept = []
            for f in sorted(found):
                if all(g[3] <= f[2] or f[3] <= g[2] or g[4] == f[4] for g in kept):
                    kept.append(f)
                    key = block[f[2]][1], model.families[f[4]]
                    want[key] = max(want.get(key, (0, 0)), (f[5], f[6]))
        got = {(n, f): (s, p) for n, f, p, s in L.named(model, text)}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_lines_of_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = {r.doc_id for r in docs.where("text rlike '(?i)licensed under|released under'").collect()}
    found = {r.doc_id for r in L.document_licences(docs).where("n_confirmed > 0").collect()}
    assert found == lines


def test_empty(spark):
    assert L.document_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_version_changes_stay_confirmed():
    m = L.LicenceModel()
    assert m.similarity(L.words("This work is licensed under the GNU General Public License, version 2."), "gpl") > 0.9
    assert m.similarity(L.words("a walk in the park with friends"), "gpl") < 0.3


def test_prose_that_sounds_like_a_notice_is_not_confirmed(spark):
    """Sentences that begin like a template, beside true notices; windows are calibrated as they are read."""
    prose = [
        "no part of this work may be reproduced in the kitchen", "any person obtaining a copy of this book must pay", "use of this source code is governed by a committee of bakers",
        "the list of conditions and the following disclaimer were read aloud", "the software is provided to schools as is usual in the county",
    ]
    filler = "the baker opened the shop at six and sold bread to people from the village until noon every day"
    texts = [*prose, *(f"{filler} {x} {filler}" for x in prose), *(f"{filler}\n{x}\n{filler}" for x in prose)]
    true = [t for f in sorted(L.TEMPLATES) for t in L.TEMPLATES[f]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"{filler}\n\n{t}\n\n{filler}") for i, t in enumerate(true)]
    got = L.scan_licences(spark.createDataFrame(docs, "doc_id long, text string")).where("confirmed").collect()
    assert not [r for r in got if r.doc_id < 100]
    assert len({r.doc_id for r in got}) >= 0.95 * len(true)


def test_own_templates():
    model = L.LicenceModel({"house": ["You may use this recipe in your own kitchen and share it with friends as long as you name the cook."]})
    model.train(L.samples_of(model, ["the river was high in spring and the bridge stayed closed", "a recipe for soup with onions and old bread"] * 20))
    assert [x[1] for x in L.named(model, "You may use this recipe in your own kitchen and share it with friends as long as you name the cook.")] == ["house"]
    assert L.named(model, "the river was high in spring") == []
