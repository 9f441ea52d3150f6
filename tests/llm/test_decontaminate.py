from __future__ import annotations

import random
from collections import Counter
from math import log

import numpy as np
from pyspark.sql import functions as F

from svlake.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string"
RNG = random.Random(3)
WORDS = [f"w{i}" for i in range(400)]
say = lambda n: [RNG.choice(WORDS) for _ in range(n)]


def brute(docs, items, threshold=0.8, size=5):
    """Best weighted share of an item's shingles over all windows of its length."""
    sets = {i: Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) for i, w in items}
    df = Counter(s for c in sets.values() for s in c)
    out = {}
    for d, w in docs:
        for i, iw in items:
            whole = sum(n * log(1 + len(items) / df[s]) for s, n in sets[i].items())
            best = 0.0
            for k in range(-len(iw), len(w)):
                window = w[max(k, 0) : max(k + len(iw), 0)]
                c = Counter(tuple(window[j : j + size]) for j in range(len(window) - size + 1))
                best = max(best, sum(min(n, c[s]) * log(1 + len(items) / df[s]) for s, n in sets[i].items()) / whole)
            if best >= threshold - 1e-12:
                out[d, i] = best
    return out


def test_equals_brute_force(spark):
    items = [(i, say(n)) for i, n in enumerate([12, 20, 20, 35, 40])]
    docs = []
    for d in range(40):
        w = say(RNG.randrange(10, 120))
        if d % 2:
            i, passage = RNG.choice(items)
            passage = list(passage)
            for _ in range(d % 3):
                passage[RNG.randrange(len(passage))] = "changed"
            at = RNG.randrange(len(w))
            w = w[:at] + passage + w[at:]
        docs.append((d, w))
    want = brute(docs, items)
    glue = [" ", ", ", "\n", " *** "]
    dd = spark.createDataFrame([(d, RNG.choice(glue).join(w).upper() + "%%%", "x") for d, w in docs], DOCS)
    di = spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEMS)
    got = {(r.doc_id, r.item_id): r.similarity for r in D.leaks(dd, di).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {k for k in want if want[k] == 1} <= {(r.doc_id, r.item_id) for r in D.leaks(dd, di).collect()}


def test_windows_are_as_long_as_their_item(spark):
    """At the defaults: start, window_words, hamming and similarity of each row are those of the item's own window, the best there is."""
    items = [(i, [f"i{i % 3}x{j}" for j in range(n)]) for i, n in enumerate([30, 30, 24, 18, 18, 33])]  # 0 and 3 share words, so do 1 and 4, 2 and 5
    docs = []
    for d in range(80):
        passage = list(items[d % 6][1])
        if d % 4 == 1:
            passage[d % len(passage)] = "changed"
        if d % 4 == 2:
            passage = passage[: len(passage) - 2]
        docs.append((d, say(RNG.randrange(30)) + passage + say(RNG.randrange(30)) * (d % 7 > 0)))
    want, by_doc, by_item = brute(docs, items), dict(docs), dict(items)
    dd = spark.createDataFrame([(d, " ".join(w), "x") for d, w in docs], DOCS)
    got = {(r.doc_id, r.item_id): r for r in D.leaks(dd, spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEMS)).collect()}
    assert got.keys() == want.keys()
    df = Counter(s for w in by_item.values() for s in {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    cuts = []
    for (d, i), r in got.items():
        w, item = by_doc[d], by_item[i]
        assert abs(r.similarity - want[d, i]) < 1e-9
        assert r.window_words == len(item) or r.start == 0 or r.start + r.window_words == len(w)
        window = w[r.start : r.start + r.window_words]
        c, sets = Counter(tuple(window[j : j + 5]) for j in range(len(window) - 4)), Counter(tuple(item[j : j + 5]) for j in range(len(item) - 4))
        weight = lambda s: log(1 + len(items) / df[s])
        assert abs(sum(min(n, c[s]) * weight(s) for s, n in sets.items()) / sum(n * weight(s) for s, n in sets.items()) - r.similarity) < 1e-9
        cuts.append((" ".join(window), " ".join(item), r.hamming))
    marks = spark.createDataFrame(cuts, "a string, b string, h int").select(D._hashes(F.col("a")).alias("wa"), D._hashes(F.col("b")).alias("wb"), "h")
    assert marks.where(f"bit_count({D._simhash('wa')} ^ {D._simhash('wb')}) <> h").count() == 0


def test_all_fingerprints_within_the_radius(spark):
    """Random fingerprints and ones some bits away: exactly the pairs of equal length within each radius, and few others meet."""
    rng = np.random.default_rng(4)
    items = rng.integers(-(2**63), 2**63 - 1, 150)
    flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in list(range(16)) * 10]
    texts = [*rng.integers(-(2**63), 2**63 - 1, 400).tolist(), *[int(np.int64(np.uint64(int(items[j % 150]) & (2**64 - 1)) ^ np.uint64(f))) for j, f in enumerate(flips)]]
    a = spark.createDataFrame([(k, k % 2, int(x)) for k, x in enumerate(texts)], "key long, n int, sim long")
    b = spark.createDataFrame([(k, k % 2, int(x)) for k, x in enumerate(items)], "item long, n int, sim long")
    apart = {(k, i): (int(x) ^ int(y)) & (2**64 - 1) for k, x in enumerate(texts) for i, y in enumerate(items) if k % 2 == i % 2}
    for radius in (0, 3, 7, D.RADIUS, 15):
        want = {(k, i, bin(x).count("1")) for (k, i), x in apart.items() if bin(x).count("1") <= radius}
        assert {tuple(r) for r in D.within(a, b, radius).collect()} == want
    assert D.met(a, b, D.RADIUS).where("key < 400").select("key", "item").distinct().count() < 0.02 * 400 * 75


def test_other_radii(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], ITEMS)
    docs = spark.createDataFrame([(1, "x one two three four five six y", None)], DOCS)
    for radius in (0, 1, 20):
        assert [(r.doc_id, r.start, r.hamming) for r in D.leaks(docs, items, radius=radius).collect()] == [(1, 1, 0)]


def test_edges(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "a b c d e f"), (4, "tiny item")], ITEMS)
    long = " ".join(say(30_000))
    docs = [(1, "x one two three four five six y", None), (1, "x one two three four five six y", None), (2, None, "c"), (3, "", "c"), (None, "one two three four five six", None), (4, "a tiny item b", None), (5, long + " One, two. THREE four five six! " + long, None), (6, "a b c d e f", None)]
    got = D.leaks(spark.createDataFrame(docs, DOCS), items).collect()
    assert sorted((r.doc_id, r.item_id, r.start) for r in got) == [(1, 1, 1), (4, 4, 1), (5, 1, 30_000)]
    assert D.leaks(spark.createDataFrame([], DOCS), items).count() == 0
    assert D.leaks(spark.createDataFrame(docs, DOCS), items.limit(0)).count() == 0


def test_cut_and_changed_copies_by_default(spark):
    """Copies far apart in Hamming distance count too: items cut at an end, and with several changed words."""
    items = [(i, [f"i{i}x{j}" for j in range(n)]) for i, n in enumerate([59, 59, 38, 15])]
    docs = []
    for d in range(120):
        i, passage = items[d % 4]
        n, keep = len(passage), {59: 48, 38: 32, 15: 13}[len(passage)] + d % 3 * (d % 4 != 3)
        passage = passage[:keep] if d % 5 < 2 else passage[n - keep :] if d % 5 < 4 else [w if j not in (1, n - 2) else "changed" for j, w in enumerate(passage)]
        docs.append((d, say(RNG.randrange(60)) + passage + say(RNG.randrange(60))))
    want = brute(docs, items)
    dd = spark.createDataFrame([(d, " ".join(w), "x") for d, w in docs], DOCS)
    got = {(r.doc_id, r.item_id): r for r in D.leaks(dd, spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEMS)).collect()}
    assert len(want) > 60 and got.keys() == want.keys()
    assert all(abs(got[k].similarity - want[k]) < 1e-9 for k in want)
    assert any(r.hamming > D.RADIUS for r in got.values())


def test_a_long_item_is_found_whole(spark):
    passage = [f"long{j}" for j in range(5_000)]
    docs = [(1, " ".join(["x", *passage, "y"]), None), (2, " ".join(passage[:2_000]), None), (3, " ".join(passage[900:]), None)]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, "one two three four five six")], ITEMS)
    got = D.leaks(spark.createDataFrame(docs, DOCS), items).collect()
    assert sorted((r.doc_id, r.item_id, r.start) for r in got) == [(1, 1, 1), (3, 1, 0)]
