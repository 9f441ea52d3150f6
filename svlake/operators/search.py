"""Random search with successive halving over linear softmax models.

Trials draw a learning rate and a weight decay. All trials of a rung learn in the same passes over the rows: each task sums the
gradients of every trial over its rows, Spark adds up the sums of the tasks, and the driver, which holds the weights only, makes a
step. After a rung the best part of its trials goes on from its weights with ``eta`` times the passes. A rung is written before the
next begins, so a search that was stopped goes on from its last whole rung.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svlake.operators.match import _kept

SPACE = {"lr": ("log", 1e-3, 1e2), "decay": ("log", 1e-7, 1e-2)}
CELLS = 1 << 20  # class scores of all trials that are held at a time
RUNG = "rung int, trial int, lr double, decay double, passes int, correct long, n long, loss double, promoted boolean, weights array<double>"


def draw(trial: int, space: dict[str, tuple[str, float, float]] = SPACE, seed: int = 10) -> dict[str, float]:
    """A trial's parameters, the same however many trials there are: ``log`` ones have a uniform logarithm, ``uniform`` ones are uniform."""
    rng = np.random.default_rng([seed, trial])
    out = {}
    for name, (kind, low, high) in sorted(space.items()):
        at = rng.random()
        out[name] = float(np.exp(np.log(low) + at * (np.log(high) - np.log(low)))) if kind == "log" else low + at * (high - low)
    return out


def _softmax(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(trial, row, class) probabilities of rows (n, d) under weights (trial, d + 1, class); the last weight is the offset."""
    z = np.matmul(x, w[:, :-1]) + w[:, -1:]
    z = np.exp(z - z.max(axis=2, keepdims=True))
    return z / z.sum(axis=2, keepdims=True)


def _batches(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    step = max(CELLS // (w.shape[0] * w.shape[2]), 1)
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for at in range(0, len(y), step):
            yield x[at : at + step], y[at : at + step], _softmax(x[at : at + step], w)


def _gradients(w: np.ndarray):
    """(vector, label) -> a task's sums (at, value): gradients of all trials one behind the other."""

    def run(batches):
        total = np.zeros_like(w)
        for x, y, p in _batches(batches, w):
            p[:, np.arange(len(y)), y] -= 1
            total[:, :-1] += np.matmul(x.T, p)
            total[:, -1] += p.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    return run


def _outcomes(w: np.ndarray):
    """(vector, label) -> a task's sums (trial, correct, n, loss)."""

    def run(batches):
        correct, loss, n = np.zeros(len(w), np.int64), np.zeros(len(w)), 0
        for _, y, p in _batches(batches, w):
            correct += (p.argmax(axis=2) == y).sum(axis=1)
            loss -= np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-300)).sum(axis=1)
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(correct), pa.array(np.full(len(w), n)), pa.array(loss)], ["trial", "correct", "n", "loss"])

    return run


def learn(rows: DataFrame, n: int, w: np.ndarray, lr: np.ndarray, decay: np.ndarray, passes: int) -> np.ndarray:
    """Weights (trial, d + 1, class) after full-batch steps over rows (vector, label), ``n`` of them. What reaches the driver is as large as the weights."""
    for _ in range(passes):
        sums = rows.mapInArrow(_gradients(w), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        g = np.zeros(w.size)
        g[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
        g = g.reshape(w.shape) / max(n, 1)
        g[:, :-1] += decay[:, None, None] * w[:, :-1]
        w = w - lr[:, None, None] * g
    return w


def outcomes(rows: DataFrame, w: np.ndarray) -> list[tuple[int, int, float]]:
    """(correct, n, loss) of each trial over rows (vector, label)."""
    sums = rows.mapInArrow(_outcomes(w), "trial long, correct long, n long, loss double").groupBy("trial").agg(F.sum("correct"), F.sum("n"), F.sum("loss")).collect()
    found = {r[0]: tuple(r)[1:] for r in sums}
    return [found.get(t, (0, 0, 0.0)) for t in range(len(w))]


def _written(spark, path: str, trials: list[int]) -> list | None:
    """A rung's rows, if all of them were written."""
    try:
        rows = sorted(spark.read.schema(RUNG).parquet(path).collect(), key=lambda r: r.trial)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return rows if [r.trial for r in rows] == trials else None


def successive_halving(
    train: DataFrame, validation: DataFrame, path: str, classes: int, trials: int = 27, first: int = 3, eta: int = 3, rungs: int = 3,
    space: dict[str, tuple[str, float, float]] = SPACE, seed: int = 10,
) -> DataFrame:
    """One row per rung and trial, as written below ``path``: rung, trial, lr, decay, passes (made so far), correct and n (validation rows), loss
    (mean), promoted (among the best 1 / eta of its rung, at least one), weights.

    ``train`` and ``validation`` have (vector array<double>, label int from 0 to classes - 1). Rows without vector or label, with a null or
    non-finite component, or with a label out of range take no part; vectors must be equally long. The best are those with most correct rows, then the least loss, then the
    smallest number. Without training rows no weight moves. A search with other parameters needs another ``path``: rungs found there must be of the same draws.
    """
    spark = train.sparkSession
    fit = "vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and label between 0 and " + str(classes - 1)
    train, validation = (_kept(d.select(F.col("vector").cast("array<double>"), F.col("label").cast("int")).where(fit)) for d in (train, validation))
    n, width = train.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = width or validation.agg(F.max(F.size("vector"))).first()[0] or 0
    live, passes = list(range(trials)), 0
    w = np.zeros((trials, width + 1, classes))
    for rung in range(rungs):
        drawn = [draw(t, space, seed) for t in live]
        lr, decay = (np.array([d[k] for d in drawn]) for k in ("lr", "decay"))
        more, passes = first * eta**rung - passes, first * eta**rung
        place = f"{path.rstrip('/')}/rung={rung}"
        rows = _written(spark, place, live)
        if rows is None:
            w = learn(train, n, w, lr, decay, more)
            found = outcomes(validation, w)
            best = sorted(range(len(live)), key=lambda k: (-found[k][0], found[k][2], live[k]))[: max(len(live) // eta, 1)]
            made = [
                (rung, t, float(lr[k]), float(decay[k]), passes, found[k][0], found[k][1], found[k][2] / max(found[k][1], 1), k in best, w[k].ravel().tolist())
                for k, t in enumerate(live)
            ]
            spark.createDataFrame(made, RUNG).coalesce(1).write.mode("overwrite").parquet(place)
            rows = _written(spark, place, live)
        if any((r.lr, r.decay, r.passes, len(r.weights)) != (lr[k], decay[k], passes, w[0].size) for k, r in enumerate(rows)):
            raise ValueError(f"{place} was written by another search")
        live = [r.trial for r in rows if r.promoted]
        w = np.array([r.weights for r in rows if r.promoted]).reshape(-1, width + 1, classes)
    return spark.read.schema(RUNG).parquet(*[f"{path.rstrip('/')}/rung={rung}" for rung in range(rungs)])


def best_weights(found: DataFrame, classes: int) -> np.ndarray:
    """Weights (d + 1, class) of the best trial of the last rung."""
    last = found.orderBy(F.desc("rung"), F.desc("correct"), "loss", "trial").first()
    return np.array(last.weights).reshape(-1, classes)


def predictor(weights: np.ndarray):
    """For ``score.scores_by``: makes a function from vectors (n, d) to class probabilities."""
    return lambda: lambda x: _softmax(np.asarray(x, np.float64), weights[None])[0].astype(np.float32)
