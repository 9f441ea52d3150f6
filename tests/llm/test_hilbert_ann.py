from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from svlake.llm import hilbert_ann as H

SCHEMA = "vec_id long, embedding array<float>, rank string"


def exact(ids, x, q, k=20):
    s = x @ x[np.flatnonzero(ids == q)[0]]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return [int(ids[i]) for i in order], s[order]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), None) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = H.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    assert (got.groupby("query_id").size() == 20).all()
    hits = 0
    for q, g in got.groupby("query_id"):
        want, _ = exact(ids, x.astype(float), q)
        hits += len(set(want) & set(g.vec_id))
        g = g.sort_values("rank")
        scores = x[[np.flatnonzero(ids == v)[0] for v in g.vec_id]].astype(float) @ x[np.flatnonzero(ids == q)[0]].astype(float)
        assert np.allclose(scores, g.score, atol=1e-9)
        assert g["rank"].tolist() == list(range(1, 21))
        assert list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))
    assert hits / len(got) > 0.9


@pytest.mark.parametrize(("clusters", "share"), [(400, 0.2), (0, 0.6)])
def test_recall_and_share_of_the_index(spark, clusters, share):
    """Clustered vectors and vectors without structure: recall against all pairs, and the share of the index that queries meet."""
    rng, n = np.random.default_rng(3), 20_000
    x = rng.normal(size=(n, 48)).astype(np.float32)
    if clusters:
        x = (rng.normal(size=(clusters, 48))[rng.integers(0, clusters, n)] + 0.4 * x).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 48).cast(pa.list_(pa.float32()))}))
    got = H.nearest(df, F.col("vec_id") % 100 == 0).toPandas()
    s = x[::100].astype(float) @ x.T.astype(float)
    s[np.arange(n // 100), np.arange(0, n, 100)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert sum(len(set(best[q // 100]) & set(g.vec_id)) for q, g in got.groupby("query_id")) / best.size >= 0.9
    reps = df.select(F.col("vec_id").alias("rep"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    asked = reps.where("rep % 100 = 0").select("rep")
    ranks = H.ranked(reps, 32)
    half = H.fitted_window(reps, asked, ranks, 20, 0.94)
    at = ranks.toPandas().pivot(index="c", columns="rep", values="rank").to_numpy()
    assert (np.sort(at, axis=1) == np.arange(n)).all()
    met = np.mean([(np.abs(at - at[:, [q]]) <= half).any(axis=0).mean() for q in range(0, n, 400)])
    print(f"half {half} of {n}, share {met:.3f}")
    assert met <= share


def test_the_whole_index_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)) * rng.uniform(0.1, 9, (300, 1))
    df = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string")
    got = H.nearest(df, F.col("vec_id") % 20 == 0, window=1.0).toPandas()
    for q, g in got.groupby("query_id"):
        assert g.sort_values("rank").vec_id.tolist() == exact(np.arange(300), x, q)[0]


def test_copies_nulls_few(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0], None) for i in range(100, 200)] + [(i, rng.normal(size=2).tolist(), None) for i in range(10)]
    rows += [(300, None, None), (301, [], None), (302, [0.0, 0.0], None), (303, [1.0, None], None), (304, [float("nan"), 1.0], None), (305, [1.0, 2.0, 3.0], None), (None, [1.0, 1.0], None), (306, [float("inf"), 1.0], None)]
    got = H.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).toPandas()
    assert set(got.query_id) == {0, 100, 120, 140, 160, 180}
    ids = np.array([r[0] for r in rows[:110]])
    x = np.array([r[1] for r in rows[:110]], np.float32).astype(float)
    for q, g in got.groupby("query_id"):
        assert g.sort_values("rank").vec_id.tolist() == exact(ids, x, q)[0]
    few = H.nearest(spark.createDataFrame(rows[:3], SCHEMA), F.col("vec_id") == 100).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r.rank)] == [101, 102]
    assert H.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 1).count() == 0


def test_curve_is_continuous():
    n = 16
    grid = np.array([[x, y] for x in range(n) for y in range(n)])
    keys = H.hilbert_keys(grid, 4)
    assert sorted(keys) == list(range(n * n))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    cube = np.array(np.unravel_index(np.arange(4**3), (4, 4, 4))).T
    path = cube[np.argsort(H.hilbert_keys(cube, 2))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
