"""Periodic runs against a scan of every period, small alphabets and real texts."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from svlake.llm import periodic_runs as pr
from svlake.llm.queries import op11_periodic_runs


def smallest_period(w) -> int:
    return next(p for p in range(1, len(w) + 1) if all(w[i] == w[i + p] for i in range(len(w) - p)))


def plain_runs(w, least: int = 12) -> list[tuple[int, int, int]]:
    found = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least and smallest_period(w[i : j + p]) == p:
                found.add((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbers(w) -> np.ndarray:
    return np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1] if len(w) else np.empty(0, np.int64)


@pytest.mark.parametrize("least", [2, 12])
@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_random_words(letters, least):
    rng = np.random.default_rng(letters)
    for _ in range(120):
        w = rng.integers(0, letters, rng.integers(0, 70)).tolist()
        for _ in range(rng.integers(0, 3)):  # repeat a piece of it
            a = rng.integers(0, len(w) + 1)
            w = w[:a] + w[a : a + rng.integers(1, 9)] * rng.integers(1, 6) + w[a:]
        assert [tuple(r) for r in pr.find_runs(numbers(w), least).tolist()] == plain_runs(w, least)


def test_few_places_at_once(monkeypatch):
    monkeypatch.setattr(pr, "CALL_PLACES", 7)
    w = [0, 1, 2] * 9 + [5, 6] * 10 + [7] * 15
    assert [tuple(r) for r in pr.find_runs(numbers(w)).tolist()] == plain_runs(w)


def test_extensions():
    w = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4, 1, 2, 3])
    ahead, back = pr.extensions(pr.name_levels(w), np.array([0, 3, 2, 0]), np.array([3, 9, 5, 9]))
    assert ahead.tolist() == [5, 3, 3, 3]
    assert back.tolist() == [0, 0, 2, 0]


def test_long_text(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 5000, 30_000)]
    text = " ".join(base + base + ["end"])
    got = pr.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_words == 60_001
    assert [tuple(r) for r in got.runs] == [(0, 60_000, 30_000)]
    assert got.collapsed == " ".join([*base, "end"])


def test_odd_rows(spark):
    line = "a b c " * 5
    rows = [(1, line, "x", 7), (1, line, "x", 7), (None, line, None, None), (2, None, "", 0), (3, "", "", 0), (4, " \n\t ", "", 0), (5, "\x0bA a\x1fa A\x0c" + "z z " * 12, "", 0), (6, "one", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed int")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.periodic_runs(df).collect()), key=str)
    want = [(0, 15, [(0, 15, 3)], "a b c"), (1, 15, [(0, 15, 3)], "a b c"), (1, 15, [(0, 15, 3)], "a b c"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], "")]
    want += [(5, 15, [(3, 12, 1)], "A a\x1fa A z z"), (6, 1, [], "one")]
    assert got == want
    assert pr.run_digests(pr.periodic_runs(df.where("doc_id > 99"))).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, sf_dir).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    sha, planted = (lambda s: hashlib.sha256(s.encode()).hexdigest()), 0
    for doc_id, text in docs:
        w = [x.decode() for x in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = plain_runs(w) if n < 1200 or h % 10 == 0 else [tuple(r) for r in pr.find_runs(numbers(w)).tolist()]
        gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert got[doc_id] == (*want, sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))), doc_id
    assert planted > 10
