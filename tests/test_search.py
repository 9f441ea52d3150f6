"""Random search by successive halving against plain numpy, resumed and whole."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from svlake.operators import score, search

SPEC = "vector array<double>, label int"


def cloud(n: int, seed: int, spread: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    return np.eye(3, 6)[y] * 2 + rng.normal(0, spread, (n, 6)), y


def table(spark, x, y):
    return spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y, strict=True)], SPEC)


def descend(x, y, lr, decay, passes, w=None):
    """One model by itself, with the offset as a column of ones."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros((x.shape[1], 3)) if w is None else w
    hot = np.eye(3)[y]
    shrink = np.r_[np.ones(x.shape[1] - 1), 0][:, None] * decay
    for _ in range(passes):
        e = np.exp(x @ w - (x @ w).max(1, keepdims=True))
        w = w - lr * (x.T @ (e / e.sum(1, keepdims=True) - hot) / len(x) + shrink * w)
    return w


def right(w, x, y) -> int:
    return int(((np.c_[x, np.ones(len(x))] @ w).argmax(1) == y).sum())


def test_draws_are_seeded_and_log_uniform():
    assert search.draw(5) == search.draw(5) != search.draw(5, seed=11)
    lr = np.log10([search.draw(t)["lr"] for t in range(2000)])
    assert lr.min() >= -3 and lr.max() <= 2
    assert np.allclose(np.histogram(lr, 5, (-3, 2))[0] / 2000, 0.2, atol=0.04)
    even = [search.draw(t, {"decay": ("uniform", 0.0, 1e-4)})["decay"] for t in range(500)]
    assert 4e-5 < np.mean(even) < 6e-5 and max(even) <= 1e-4


def test_equals_models_trained_one_by_one_and_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    (x, y), (u, v) = cloud(300, 1), cloud(200, 2)
    odd = spark.createDataFrame([(None, 1), ([1.0] * 6, None), ([1.0] * 5 + [None], 1), ([float("nan")] * 6, 1), ([1.0] * 6, 3), ([1.0] * 6, -1), ([float("-inf")] * 6, 0)], SPEC)
    train, held = table(spark, x, y).union(odd).repartition(3).withColumn("weights", F.lit("clashes")), table(spark, u, v).union(odd)
    passes = []
    whole = search.learn
    monkeypatch.setattr(search, "learn", lambda *a: passes.append(a[-1]) or whole(*a))
    run = lambda p, rungs: search.successive_halving(train, held, str(tmp_path / p), 3, trials=6, first=2, eta=2, rungs=rungs)
    got = {(r.rung, r.trial): r for r in run("whole", 3).collect()}
    assert passes == [2, 2, 4]
    live, models = list(range(6)), {}
    for rung, more in enumerate((2, 2, 4)):
        for t in live:
            d = search.draw(t)
            models[t] = descend(x, y, d["lr"], d["decay"], more, models.get(t))
            r = got.pop((rung, t))
            assert np.allclose(np.array(r.weights).reshape(7, 3), models[t], atol=1e-8)
            assert (r.correct, r.n, r.passes) == (right(models[t], u, v), 200, 2 * 2**rung)
        order = sorted(live, key=lambda t: -right(models[t], u, v))
        live = sorted(r.trial for r in run("whole", 3).where(f"rung = {rung} and promoted").collect())
        assert [right(models[t], u, v) for t in order][: len(live)] == sorted((right(models[t], u, v) for t in live), reverse=True)
    assert not got and passes == [2, 2, 4]  # read again, nothing was learned again
    run("stopped", 1)
    passes.clear()
    columns = ["rung", "trial", "correct", "promoted"]
    assert sorted(run("stopped", 3).select(*columns).collect()) == sorted(run("whole", 3).select(*columns).collect())
    assert passes == [2, 4]
    with pytest.raises(ValueError, match="another search"):
        search.successive_halving(train, held, str(tmp_path / "whole"), 3, trials=6, first=2, eta=2, rungs=1, seed=1)


def test_beats_a_fixed_grid_of_the_same_budget(spark, tmp_path):
    """27, 9 and 3 trials make 27 * 3 + 9 * 6 + 3 * 18 = 189 passes; a grid of four rates and no search gets 47 each."""
    (x, y), (u, v) = cloud(400, 3, 1.0), cloud(400, 4, 1.0)
    found = search.successive_halving(table(spark, x * 0.02, y), table(spark, u * 0.02, v), str(tmp_path / "s"), 3)
    assert [found.where(f"rung = {k}").count() for k in range(3)] == [27, 9, 3]
    assert found.where("rung < 2 and promoted").count() == 12
    grid = max(right(descend(x * 0.02, y, lr, 1e-4, 47), u * 0.02, v) for lr in (1e-4, 1e-3, 1e-2, 1e-1))
    best = search.best_weights(found, 3)
    assert right(best, u * 0.02, v) >= grid
    rows = table(spark, u * 0.02, v).union(spark.createDataFrame([(None, 7)], SPEC))
    scored = score.scores_by(search.predictor(best), rows, 16).select("scores", "label").collect()
    assert [r.scores for r in scored if r.label == 7] == [None]
    assert sum(int(np.argmax(r.scores)) == r.label for r in scored if r.scores) == right(best, u * 0.02, v)
    assert score.scores_by(search.predictor(best), rows.limit(0)).count() == 0


def test_nothing_to_learn_from(spark, tmp_path):
    empty = spark.createDataFrame([], SPEC)
    found = search.successive_halving(empty, empty, str(tmp_path / "none"), 2, trials=3, rungs=2)
    assert {(r.n, r.loss) for r in found.collect()} == {(0, 0.0)}
