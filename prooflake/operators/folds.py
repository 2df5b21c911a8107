"""Regressions on all folds at once: one pass over the rows serves every model.

A model leaves one fold out, so it is the same rows with another weight: 0 in its fold, the balance of its own training classes elsewhere. A pass
adds up loss, gradient and second derivatives of all models that haven't settled, and each takes a Newton step (halved where it would
climb). How many passes there are depends on the hardest model and not on their number. The objective is that of `models.regression`: mean
weighted log loss of a softmax with an L2 penalty on all but the intercepts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prooflake.operators.models import EPSILON
from prooflake.operators.sums import summed
from prooflake.storage import stored

#: Left out by the model that is fitted on all rows.
NOTHING = -1
#: Parameters of a model, whose square a task holds for each; more want a method without second derivatives.
MOST_PARAMETERS = 512
MOST_PASSES, SETTLED = 60, 1e-9


class FoldModel(NamedTuple):
    """A softmax regression: classes, mean and deviation of the training rows' columns, weights with the intercepts in the last row."""

    left_out: int
    classes: list[int]
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _design(self, x) @ self.weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.classes)[self.scores(x).argmax(1)]


def _design(model: FoldModel, x: np.ndarray) -> np.ndarray:
    return np.hstack([(x - model.mean) / model.std, np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(first, batch.num_columns)], 1)


def _start(rows: DataFrame, columns: list[str]) -> tuple[list[FoldModel], dict[int, dict[int, float]], dict[int, int]]:
    """Models with weights of 0, the weight of each class in each, and the number of training rows of each."""
    # variances and means of all columns in one row a fold
    stats = rows.groupBy("fold").agg(F.count("*").alias("n"), F.array(*(F.avg(c) for c in columns)).alias("mean"), F.array(*(F.var_pop(c) for c in columns)).alias("var")).collect()
    counts = {(r.fold, r.label): r.n for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    found, weights, sizes = [], {}, {}
    for out in [NOTHING, *sorted(r.fold for r in stats)]:
        used = [r for r in stats if r.fold != out]
        own: dict[int, int] = {}
        for (fold, label), n in counts.items():
            if fold != out:
                own[label] = own.get(label, 0) + n
        if not used:
            continue
        n = sum(r.n for r in used)
        mean = sum(r.n * np.array(r.mean) for r in used) / n
        var = sum(r.n * (np.array(r["var"]) + (np.array(r.mean) - mean) ** 2) for r in used) / n
        classes = sorted(own)
        found.append(FoldModel(out, classes, mean, np.sqrt(var) + EPSILON, np.zeros((len(columns) + 1, len(classes)))))
        weights[out], sizes[out] = {c: n / (len(classes) * k) for c, k in own.items()}, n
    return found, weights, sizes


def _measure(models: list[FoldModel], weights: dict[int, dict[int, float]]):
    """For a batch (fold, label, columns...): loss, gradient and second derivatives of each model, as one vector."""

    def measure(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        fold, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        x = _matrix(batch, 2)
        out = {}
        for m in models:
            used = fold != m.left_out
            if not used.any():
                continue
            z, y = _design(m, x[used]), np.searchsorted(m.classes, label[used])
            w = np.array([weights[m.left_out][c] for c in m.classes])[y]
            s = z @ m.weights
            s -= s.max(1, keepdims=True)
            p = np.exp(s)
            total = p.sum(1, keepdims=True)
            loss = float((w * (np.log(total[:, 0]) - s[np.arange(len(y)), y])).sum())
            p /= total
            off = p.copy()
            off[np.arange(len(y)), y] -= 1
            gradient = (z.T @ (w[:, None] * off)).T
            n, d = len(m.classes), z.shape[1]
            second = np.empty((n, d, n, d))
            for a in range(n):
                for b in range(a, n):
                    block = z.T @ ((w * p[:, a] * ((a == b) - p[:, b]))[:, None] * z)
                    second[a, :, b] = block
                    second[b, :, a] = block.T
            out[m.left_out] = np.concatenate([[loss], gradient.ravel(), second.ravel()])
        return out

    return measure


def fit_folds(rows: DataFrame, columns: list[str], c: float = 1.0) -> tuple[list[FoldModel], int]:
    """The models that leave out each fold of rows (fold, label, columns), first the one that leaves out nothing, and the passes they took."""
    data = stored(rows.select(F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), *(F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in columns)), "fold-rows")
    models, weights, sizes = _start(data, columns)
    now = {m.left_out: m for m in models}
    if any(m.weights.size > MOST_PARAMETERS for m in models):
        raise ValueError(f"more than {MOST_PARAMETERS} parameters a model")
    open_, tried, passes = set(now), {}, 0
    while open_ and passes < MOST_PASSES:
        passes += 1
        sums = summed(data, _measure([now[k] for k in sorted(open_)], weights))
        for k in sorted(open_):
            m, n = now[k], sizes[k]
            shape, reg = m.weights.T.shape, 1.0 / (c * max(n, 1))
            punished = np.ones(shape)
            punished[:, -1] = 0
            flat = m.weights.T.ravel()
            size = flat.size
            value = sums[k][0] / n + reg / 2 * float((punished.ravel() * flat**2).sum())
            if k in tried and value > tried[k][0] + 1e-12:  # the step led uphill: half of it
                before, step = tried[k][1], tried[k][2] / 2
                tried[k] = (tried[k][0], before, step)
            else:
                gradient = sums[k][1 : 1 + size] / n + reg * punished.ravel() * flat
                second = sums[k][1 + size :].reshape(size, size) / n + reg * np.diag(punished.ravel())
                # adding a number to all intercepts changes nothing: the shortest step
                before, step = flat, -np.linalg.lstsq(second, gradient, rcond=1e-12)[0]
                tried[k] = (value, before, step)
            now[k] = m._replace(weights=(before + step).reshape(shape).T)
            if np.abs(step).max(initial=0.0) < SETTLED:
                open_.remove(k)
    return [now[m.left_out] for m in models], passes


def judged(rows: DataFrame, columns: list[str], models: list[FoldModel]) -> DataFrame:
    """(fold, label, pred): every row by the model that left out its fold, and by the one that left out nothing, as fold -1. One narrow pass."""
    by = {m.left_out: m for m in models}

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            x = _matrix(batch, 2)
            pred = np.zeros(len(x), np.int64)
            for k in np.unique(fold).tolist():
                if k in by:
                    pred[fold == k] = by[k].predict(x[fold == k])
            own = np.isin(fold, list(by))
            for f, y, p in ((fold[own], label[own], pred[own]), (np.full(len(x), NOTHING), label, by[NOTHING].predict(x))):
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in (f, y, p)], names=["fold", "label", "pred"])

    data = rows.select(F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), *(F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in columns))
    return data.mapInArrow(work, "fold int, label int, pred int")
