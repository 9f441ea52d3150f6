"""The filter audit against removing documents one by one."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest

from svlake.llm import filter_audit as fa


def plain(docs: list[tuple], labels: list[tuple]) -> dict:
    """Apply the filters in every order to rows (doc_id, text, lang)."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    rows = []
    for doc_id, text, lang in docs:
        t = text or ""
        w = [x for x in t.encode().split() if x]
        same = [d for d, x, _ in docs if (x or "") == t]
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": any(d is not None and (doc_id is None or d < doc_id) for d in same),
        }
        rows.append((lang or "", {f for f, x in fails.items() if x}, doc_id))
    out, shares = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                before = set(order[: step - 1])
                redundant = sum(1 for r in rows if r[0] == part and f in r[1] and r[1] & before)
                unique = sum(1 for r in rows if r[0] == part and r[1] == {f})
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(r[2] in good for r in gone), sum(r[2] in toxic for r in gone)]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df) -> dict:
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in fa.COUNTS) for r in df.collect()}


def test_equals_removing_one_by_one(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(150)] + ["LOUD", "A$B", "ünï", "X"]
    docs = []
    for i in range(120):
        text = " ".join(rng.choice(vocabulary, rng.integers(0, 160)))
        docs.append((int(rng.integers(0, 90)), str(text), ["en", "de", None, ""][i % 4]))
    docs += [(3, None, "en"), (500, "", "xx"), (None, "", None), (None, docs[0][1], "en"), docs[0], docs[0], (700, docs[0][1], "de"), (701, "PLAIN X\x0b" * 70, "fr"), (702, "lone text", "fr")]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in rng.integers(0, 90, 60)] + [(None, 1, 1), (700, None, 1), (701, 1, None), (9999, 1, 1)]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, lang string, mask string, part int")
    found = fa.document_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = plain(docs, labels)
    assert got(found) == want
    assert len(want) == 600 * 5


def test_empty_tables(spark):
    d, lab = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.document_audit(d, lab).count() == 0
    assert fa.document_audit(spark.createDataFrame([(1, "a", "en")], d.schema), lab).agg({"good_lost": "sum"}).first()[0] == 0


def test_matrices():
    at, *all_ = fa.outcomes(5)
    assert [m.shape for m in all_] == [(32, 600)] * 4
    kept, removed, redundant, unique = all_
    fails = (np.arange(32)[:, None] >> at) & 1
    assert (removed + redundant == fails).all()
    assert (kept[0] == 1).all() and not removed[0].any()
    assert (unique.sum(axis=0) == 1).all()
    assert removed[31].sum() == 120  # a document that fails all is removed once in each order


@pytest.mark.parametrize("names", ["A", "XYZ"])
def test_other_numbers_of_filters(spark, names):
    n = 1 << len(names)
    cells = spark.createDataFrame([("p", m, m + 1, 1, 0) for m in range(n)], "part string, mask int, n long, good long, toxic long")
    rows = fa.audit(cells, names).collect()
    assert len(rows) == len(list(permutations(names))) * len(names)
    for r in rows:
        own, before = 1 << names.index(r.filter), sum(1 << names.index(c) for c in r.filter_order[: r.step - 1])
        assert r.removed == sum(m + 1 for m in range(n) if m & own and not m & before)
        assert r.unique_fails == own + 1
