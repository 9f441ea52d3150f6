from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from svlake.llm import mixing as M

SCHEMA = "doc_id long, text string, source string"


def fill(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[n] for n in capped)
        rest = sum(w[n] for n in names if n not in capped)
        target = {n: most * sizes[n] if n in capped else left * w[n] / rest for n in names} if rest else {n: most * sizes[n] for n in names}
        over = {n for n in names if n not in capped and target[n] > most * sizes[n]}
        if not over:
            return target
        capped |= over


def check(spark, rows, block):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = M.mixed_sizes(docs, block_words=block, shards=4).collect()
    sizes = Counter()
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    for i, k in n.items():
        sizes[source[i]] += k
    want, taken = fill(sizes), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == n[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= block
    return sorted(map(tuple, got), key=str)


def test_targets_and_reruns(spark):
    rows = [(i, "w " * (7 * i % 90), ["b", "a", "é", None, "Z"][i % 5]) for i in range(60)] + [(100, None, "a"), (101, "", "zz"), (102, "x " * 9000, "tiny")]
    assert check(spark, rows, 16) == check(spark, rows[::-1], 16)


def test_small_sources_are_capped(spark):
    check(spark, [(1, "a " * 10, "a"), (2, "b " * 1000, "b"), (3, "c " * 500, "c")], 8)


def test_repeated_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b", None)], SCHEMA)
    assert M.mixed_sizes(docs).count() == 3
    assert M.mixed_sizes(docs.limit(0)).count() == 0
    assert M.mixed_documents(docs.limit(0), shards=2).count() == 0


def test_blocks_are_disjoint_and_shards_even(spark):
    rows = [(i, "w " * (1 + 11 * i % 300), f"s{i % 4}") for i in range(80)]
    blocks = M.mix(spark.createDataFrame(rows, SCHEMA), block_words=8, shards=8)[1].collect()
    assert len({(b.row, b.epoch, b.block) for b in blocks}) == len(blocks)
    counts = Counter(b.shard for b in blocks)
    assert set(counts) == set(range(8))
    assert max(counts.values()) - min(counts.values()) <= 3
    per = defaultdict(int)
    for b in blocks:
        per[b.row] += b.words
    assert len(per) <= 80


def test_tree_keeps_quotas_and_is_fair(spark):
    quotas = {0: 1000, 1: 10, 2: 0, 3: 333}
    df = spark.createDataFrame([(i, q) for i, q in quotas.items()], "ix int, quota long")
    rows = M.splitting_tree(df, 3, seed=1).collect()
    assert len(rows) == 32
    assert {i: sum(r.quota for r in rows if r.ix == i) for i in quotas} == quotas
    totals = Counter()
    for r in rows:
        totals[r.shard] += r.quota
    assert max(totals.values()) - min(totals.values()) <= 1
    n, k, d = 60, 25, 20
    expr = M._hypergeometric(f"{n}L", f"{k}L", f"{d}L", "u")
    draws = [r.x for r in spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u")).select(F.expr(expr).alias("x")).collect()]
    from math import comb

    for x, c in Counter(draws).items():
        p = comb(k, x) * comb(n - k, d - x) / comb(n, d)
        assert abs(c / 20_000 - p) < 2e-4 + 1e-3 * p


def test_block_texts(spark):
    docs = spark.createDataFrame([(1, "a b  c\nd e", "s"), (2, "f g", "t")], SCHEMA)
    got = M.block_texts(docs, block_words=2, shards=2).collect()
    assert {r.text for r in got} <= {"a b", "c d", "e", "f g"}
    whole = M.mixed_documents(docs, shards=2).collect()
    assert {tuple(r) for r in whole} <= {(1, "a b  c\nd e", "s"), (2, "f g", "t")}


def test_long_documents_do_not_stop_a_pass(spark):
    """A document that can't fit leaves room for those that can; a source misses its target by half a document at most."""
    rows = [(1, "long " * 90, "a")] + [(k, "w", "a") for k in range(2, 12)] + [(50 + k, "b " * (1 + k % 7), "b") for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for seed in range(3):
        got = M.mix(docs, block_words=None, shards=2, weights=(1, 9), seed=seed)
        taken = got[1].groupBy("doc_id").agg(F.sum("words").alias("taken"))
        r = got[0].join(taken, "doc_id", "left").join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        for x in r:
            assert abs((x.taken or 0) - x.target) <= (x.target if x.source == "a" else 4)
        assert next(x.taken or 0 for x in r if x.source == "a") > 0


def test_rows_without_or_with_repeated_ids_count_by_themselves(spark):
    rows = [(None, "a " * 10, "a", "x"), (None, "a " * 20, "a", "x"), (3, "a " * 5, "a", "y"), (3, "b " * 40, "b", "y"), (4, "", "b", None), (5, None, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times string").withColumn("row_key", F.lit(1))
    out = M.mixed_documents(docs, shards=2)
    assert out.columns == docs.columns
    count = Counter((r.doc_id, r.text) for r in out.collect())
    assert count[4, ""] == count[5, None] == 1
    sizes = {"a": 35, "b": 40}
    want = fill(sizes | {"c": 0})
    for source, n in sizes.items():
        taken = sum(len(t.split()) * k for (_, t), k in count.items() if t and t[0] == source)
        assert abs(taken - want[source]) <= 20
        assert all(k <= 3 for k in count.values())
