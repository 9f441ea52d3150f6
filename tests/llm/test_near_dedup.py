from __future__ import annotations

import random

import pytest

from svlake.llm import near_dedup

SCHEMA = "doc_id long, text string, n_shingles string, kept int"


def shingles(text, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent=80):
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    for n, (i, s) in enumerate(sets):
        for j, t in sets[n + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 30, 80]))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(rng.choice([1, 1, 4, 8])):
            c = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                c[rng.randrange(len(c))] = rng.choice(words)
            text = rng.choice([" ", "\n", "  "]).join(c)
            rows.append(text.upper() if rng.random() < 0.2 else text)
    rng.shuffle(rows)
    out = list(enumerate(rows, 5))
    return [*out, (1000, None), (1001, ""), (1002, " \t"), (1003, "é É"), (1004, "É é"), (1005, "x " * 5000), (1006, "X " * 5000)]


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force(spark, size):
    rows = corpus(size)
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA), words=size).collect()
    want = brute(rows, size)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, size)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_empty(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, "a b c"), (3, "q r s"), (1, "q r s")]
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA), words=2).collect()
    assert len(got) == 7
    assert {r.doc_id: r.component_id for r in got} == {1: 1, None: None, 2: 1, 3: 1}
    assert all(r.kept for r in got if r.doc_id is None)
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pruning_bound():
    steps = near_dedup.least_matches(0.8, 1e-6, 96, 32)
    assert [n for n, _ in steps] == [32, 64, 96]
    assert all(0 < m < 0.8 * n for n, m in steps)


def test_rows_that_share_an_id_are_one_node(spark):
    """Every text of a repeated id links, whichever comes first; brute force over all texts of an id."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(6)]
    change = lambda w: " ".join(x if rng.random() > 0.01 else f"z{rng.random()}" for x in w)
    rows = [(i, change(base[i % 6])) for i in range(30)] + [(40, change(base[0])), (40, change(base[1])), (41, change(base[3])), (41, " ".join(base[2])), (41, "alone"), (5, change(base[4]))]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, t) in enumerate(rows):
        for j, u in rows[n + 1 :]:
            s, v = shingles(t, 2), shingles(u, 2)
            if 100 * len(s & v) >= 80 * len(s | v):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for order in (rows, rows[::-1]):
        got = near_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), words=2).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(i, root(i)) for i, _ in rows}


def near_family(seed, bases, copies, changes, size=60):
    """Copies of related texts, each with as many words changed as leaves most pairs just below the threshold."""
    rng = random.Random(seed)
    first = [f"w{rng.randrange(2000)}" for _ in range(size)]
    rows = []
    for _ in range(bases):
        base = list(first)
        for at in rng.sample(range(size), 3):
            base[at] = f"b{rng.random()}"
        for _ in range(copies):
            c = list(base)
            for at in rng.sample(range(size), rng.choice(changes)):
                c[at] = f"z{rng.random()}"
            rows.append(" ".join(c))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("per_member", "family"), [(64, 1000), (0, 3)])
def test_crowded_buckets_equal_brute_force(spark, per_member, family):
    """Members with different pivots: pair by pair, and all by a pivot of the bucket, with one copy of a pivot's set and with several."""
    rows = near_family(3, 6, 12, (2, 3, 4, 5))
    repeated = [*rows, (3, rows[9][1]), (5, "alone"), (len(rows), rows[4][1] + " more")]
    for found in (rows, repeated):
        got = near_dedup.near_duplicates(spark.createDataFrame(found, "doc_id long, text string"), words=2, pairs_per_member=per_member, family=family).collect()
        assert {r.doc_id: r.component_id for r in got} == brute_nodes(found, 2)


def brute_nodes(rows, size):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, size)) for i, t in rows]
    for n, (i, s) in enumerate(sets):
        for j, t in sets[n + 1 :]:
            if 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in parent}


def test_texts_of_few_ids_are_not_shuffled(spark):
    """Without broadcast joins, as ids are too many for one on large tables, a broadcast bitmap drops other rows before the shuffle."""
    from svlake.llm.common import among

    rows = spark.range(-2000, 8000).selectExpr("if(id % 97 = 0, null, id * 1000003) as doc_id", "repeat('x', 20) as text").union(spark.createDataFrame([(None, "n")], "doc_id long, text string"))
    ids = spark.range(-300, 300).selectExpr("id * 1000003 as rep").union(spark.createDataFrame([(5,), (None,)], "rep long"))
    want = sorted(r.doc_id for r in rows.join(ids.withColumnRenamed("rep", "doc_id").distinct(), "doc_id", "left_semi").collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (4_000_000, 10):
            found = among(rows, "doc_id", ids, most=most)
            assert sorted(r.doc_id for r in found.collect()) == want
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (most > 10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
