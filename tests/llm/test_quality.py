from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from svlake.llm import common, quality

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_keeps_good_and_rejects_bad(spark, sf_dir):
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    got = {r.doc_id: r.kept for r in quality.importance_resample(d, lab).collect()}
    assert len(got) == d.count()
    marks = {r.doc_id: r.quality for r in lab.collect()}
    good = [got[i] for i, q in marks.items() if q == 1]
    bad = [got[i] for i, q in marks.items() if q == 0]
    assert np.mean(good) > 0.97
    assert np.mean(bad) < 0.1


def test_k_is_exact_and_runs_agree(spark, sf_dir):
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    a = quality.importance_resample(d, lab, k=50, temperature=1000.0)
    kept = {r.doc_id for r in a.where("kept").collect()}
    assert len(kept) == 50
    assert kept == {r.doc_id for r in quality.importance_resample(d.repartition(3), lab, k=50, temperature=1000.0).where("kept").collect()}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, None), (3, ""), (None, "good words"), (1, "good words here"), (4, "x" * 100_000)], DOCS)
    none = spark.createDataFrame([], LABELS)
    got = [(r.doc_id, r.kept) for r in quality.importance_resample(docs, none).collect()]
    assert sorted(got, key=str) == sorted([(1, True), (1, True), (2, False), (3, False), (4, True), (None, True)], key=str)
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (4, None), (4, 0)], LABELS)
    assert quality.importance_resample(docs, labels).count() == 6
    assert quality.importance_resample(spark.createDataFrame([], DOCS), labels).count() == 0


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 1001])
def test_kth_largest(spark, k):
    values = np.random.default_rng(1).normal(size=1000) ** 3
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    want = np.inf if k == 0 else -np.inf if k > 1000 else np.sort(values)[-k]
    assert common.kth_largest(df, "v", k, bins=8, few=20) == want


def test_weights_equal_direct_ones(spark, sf_dir):
    """Log weights from counts by hand, in plain Python."""
    d = common.materialise(read(spark, sf_dir, "documents").limit(60).select("doc_id", "text"), "few")
    rows = d.collect()
    marks = {r.doc_id: int(i % 3 > 0) for i, r in enumerate(rows[:30])}
    labels = spark.createDataFrame(list(marks.items()), LABELS)
    grams = {r.doc_id: [int(f) for f in quality.features(r.text)] for r in rows}
    raw, target = Counter(), Counter()
    for i, f in grams.items():
        raw.update(f)
        target.update(f if marks.get(i) == 1 else [])
    blocks = [range(quality.UNI), range(quality.UNI, quality.UNI + quality.BI), range(quality.UNI + quality.BI, quality.SLOTS)]
    ratio = {}
    for block in blocks:
        whole, seen, extra = sum(raw[s] + 1 for s in block), sum(target[s] for s in block), 0.5 * len(block) / 8
        for s in block:
            p = (raw[s] + 1) / whole
            ratio[s] = math.log((target[s] + extra * p) / (seen + extra) / p)
    total = {i: sum(ratio[s] for s in f) for i, f in grams.items()}
    size = {i: sum(s < quality.UNI for s in f) for i, f in grams.items()}
    shift = quality.boundary([(total[i] / size[i], q) for i, q in marks.items() if size[i]])
    for r in quality.importance_resample(d, labels).collect():
        assert r.n_tokens == size[r.doc_id]
        if size[r.doc_id]:
            assert r.log_weight == pytest.approx(max(-8, min(8, total[r.doc_id] - shift * size[r.doc_id])), abs=1e-6)
        else:
            assert r.log_weight is None


def test_draws_follow_the_weights(spark):
    """Shares of each weight among the drawn against drawing one by one without replacement; a threshold would draw the heaviest alone."""
    n, k = 4000, 3000
    weights = np.log([1.0, 2.0, 8.0])
    rows = spark.range(3 * n).select("id", F.element_at(F.array(*map(F.lit, weights.tolist())), (F.col("id") % 3 + 1).cast("int")).alias("log_weight"))
    rng, want = np.random.default_rng(5), np.zeros(3)
    for _ in range(20):
        order = np.argsort(rng.exponential(size=3 * n) / np.tile(np.exp(weights), n))[:k]  # exponential clocks: successive draws by weight
        want += np.bincount(order % 3, minlength=3) / 20
    for seed in (1, 2, 3):
        drawn = quality.gumbel_top_k(rows, ["id"], k, seed=seed).where("kept")
        got = np.array([r["n"] for r in drawn.groupBy((F.col("id") % 3).alias("c")).agg(F.count("*").alias("n")).orderBy("c").collect()])
        assert got.sum() == k
        assert ((got - want) ** 2 / want).sum() < 13.8  # chi-square, 2 degrees, 0.1 %
    other = {r.id for r in quality.gumbel_top_k(rows, ["id"], k, seed=4).where("kept").collect()}
    assert len(other & {r.id for r in drawn.collect()}) < 0.95 * k


def test_the_draw_decides_near_the_boundary(spark, sf_dir):
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    kept = lambda **x: {r.doc_id for r in quality.importance_resample(d, lab, clip=2.0, **x).where("kept").collect()}
    rows = quality.importance_resample(d, lab, clip=2.0).collect()
    above = {r.doc_id for r in rows if r.log_weight is not None and r.log_weight >= 0}
    assert kept() != above
    assert kept(seed=1) != kept(seed=2)
    expected = sum(1 / (1 + math.exp(-r.log_weight)) for r in rows if r.log_weight is not None)
    assert len(kept()) == round(expected)


def test_extra_columns_and_long_texts(spark):
    rows = [(1, "good plain words " * 30_000, 1, 2.0), (2, "zz!!zz##" * 50_000, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality long, log_weight double").withColumn("kept", F.lit("x"))
    got = quality.importance_resample(docs, spark.createDataFrame([(1, 1), (2, 0)], LABELS))
    assert got.columns == ["doc_id", "n_tokens", "log_weight", "sample_key", "kept"]
    assert {r.doc_id: r.kept for r in got.collect()} == {1: True, 2: False}
