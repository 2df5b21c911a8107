"""A training loop with a history: mini-batch descent on all partitions, warm-up and decay of the rate, the best epoch by validation.

The detector is a network of one hidden layer over two blocks, hashed terms of the text and standardised number columns (without hidden units it
is a linear model). Its parameters are bounded by buckets x hidden units; they go to the tasks by broadcast, each task adds up the gradient of its
rows of a mini-batch, and the driver gets a few sums. A mini-batch is a hash of the key, so it depends on neither partitions nor row order.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prooflake.operators.models import balanced_weights, ngrams, normalizer
from prooflake.operators.sums import summed
from prooflake.storage import stored

EPOCHS, STEPS, RATE, WARM_UP, CLIP, DECAY = 5, 8, 0.03, 0.1, 1.0, 0.01
BUCKETS, HIDDEN, TEXT_CHARS = 2048, 16, 5000
#: Rows whose dense vectors a task holds at once.
ROWS_AT_ONCE = 256


class Net(NamedTuple):
    """x -> tanh(x w1 + b1) w2 + b2, or x w2 + b2 without hidden units (w1 None)."""

    w1: np.ndarray | None
    b1: np.ndarray | None
    w2: np.ndarray
    b2: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [p for p in self if p is not None]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def from_flat(self, values: np.ndarray) -> Net:
        out, at = [], 0
        for p in self:
            out.append(None if p is None else values[at : at + p.size].reshape(p.shape))
            at += 0 if p is None else p.size
        return Net(*out)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden layer, probabilities)."""
        h = x if self.w1 is None else np.tanh(x @ self.w1 + self.b1)
        s = h @ self.w2 + self.b2
        s = np.exp(s - s.max(1, keepdims=True))
        return h, s / s.sum(1, keepdims=True)

    def backward(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """(weighted log loss, gradient of it as one vector), both summed over the rows."""
        h, p = self.forward(x)
        loss = float(-(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
        p[np.arange(len(y)), y] -= 1
        off = weight[:, None] * p
        last = [h.T @ off, off.sum(0)]
        if self.w1 is None:
            return loss, np.concatenate([g.ravel() for g in last])
        back = (off @ self.w2.T) * (1 - h**2)
        return loss, np.concatenate([g.ravel() for g in (x.T @ back, back.sum(0), *last)])


def new_net(inputs: int, hidden: int, classes: int, seed: int = 42) -> Net:
    rng = np.random.default_rng(seed)
    if not hidden:
        return Net(None, None, np.zeros((inputs, classes)), np.zeros(classes))
    return Net(rng.normal(0, 1, (inputs, hidden)) / np.sqrt(64), np.zeros(hidden), rng.normal(0, 1, (hidden, classes)) / np.sqrt(hidden), np.zeros(classes))


def inputs(rows: DataFrame, text: str, key: str, numbers: list[str], stats: DataFrame | None, buckets: int = BUCKETS) -> DataFrame:
    """(key, label, terms: hashes of the text's words and word pairs, numbers: standardised columns) of rows."""
    terms = F.transform(ngrams(F.substring(F.coalesce(F.col(text), F.lit("")), 1, TEXT_CHARS)), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
    if stats is None:
        return rows.select(F.col(key).alias("key"), F.col("label").cast("int").alias("label"), terms.alias("terms"), F.array().cast("array<double>").alias("numbers"))
    scaled = F.array(*((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in numbers))
    return rows.crossJoin(F.broadcast(stats)).select(F.col(key).alias("key"), F.col("label").cast("int").alias("label"), terms.alias("terms"), scaled.alias("numbers"))  # stats is one row


def dense(terms: list[list[int]], numbers: list[list[float]], buckets: int) -> np.ndarray:
    """A row each: 1 + ln of the number of each hash, to unit length, and the numbers behind."""
    out = np.zeros((len(terms), buckets + (len(numbers[0]) if numbers else 0)))
    for k, row in enumerate(terms):
        if row:
            at, n = np.unique(row, return_counts=True)
            w = 1 + np.log(n)
            out[k, at] = w / np.linalg.norm(w)
    if numbers:
        out[:, buckets:] = numbers
    return out


def _chunks(batch: pa.RecordBatch, buckets: int, first: int):
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(at, ROWS_AT_ONCE)
        yield part, dense(part.column(first).to_pylist(), part.column(first + 1).to_pylist(), buckets)


def _gradient(rows: DataFrame, net: Net, buckets: int) -> tuple[float, np.ndarray, float]:
    """(mean loss, mean gradient, sum of weights) over rows (label, weight, terms, numbers)."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def measure(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        total = 0.0
        for part, x in _chunks(batch, buckets, 2):
            y, w = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            loss, gradient = shared.value.backward(x, y, w)
            total = total + np.concatenate([[loss, w.sum()], gradient])
        return {0: total}

    sums = summed(rows.select("label", "weight", "terms", "numbers"), measure).get(0)
    shared.unpersist()
    if sums is None or not sums[1]:
        return 0.0, np.zeros_like(net.flat()), 0.0
    return sums[0] / sums[1], sums[2:] / sums[1], float(sums[1])


def _validated(rows: DataFrame, net: Net, buckets: int, classes: int) -> tuple[float, float, float]:
    """(loss, accuracy, macro-F1 over the labels that occur) on rows, in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def measure(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        loss, table = 0.0, np.zeros((classes, classes))
        for part, x in _chunks(batch, buckets, 1):
            y = part.column(0).to_numpy(zero_copy_only=False)
            p = shared.value.forward(x)[1]
            loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
            np.add.at(table, (y, p.argmax(1)), 1)
        return {0: np.concatenate([[loss], table.ravel()])}

    sums = summed(rows.select("label", "terms", "numbers"), measure).get(0)
    shared.unpersist()
    if sums is None:
        return 0.0, 0.0, 0.0
    table = sums[1:].reshape(classes, classes)
    both = table.sum(0) + table.sum(1)
    f1 = 2 * np.diag(table)[both > 0] / both[both > 0]
    return float(sums[0] / table.sum()), float(np.trace(table) / table.sum()), float(f1.mean())


def rate_at(step: int, steps: int, rate: float = RATE, warm_up: float = WARM_UP) -> float:
    """The rate of a step: rising over the first part of all steps, then falling to 0 in a line."""
    first = max(1, int(warm_up * steps))
    return rate * (step + 1) / first if step < first else rate * (steps - step) / max(1, steps - first)


def train(train_rows: DataFrame, validation: DataFrame, classes: int, numbers: int, buckets: int = BUCKETS, hidden: int = HIDDEN, epochs: int = EPOCHS, steps: int = STEPS, rate: float = RATE, seed: int = 42) -> tuple[Net, list[dict]]:
    """(the net of the best epoch, the history) from inputs rows. Training classes are balanced; gradients are cut to length CLIP; of equal epochs the
    first is best."""
    data = stored(balanced_weights(train_rows), "training-rows")
    held = stored(validation, "validation-rows")
    net = new_net(buckets + numbers, hidden, classes, seed)
    values = net.flat()
    first, second = np.zeros_like(values), np.zeros_like(values)
    best, history = net, []
    for epoch in range(epochs):
        losses, weights = [], []
        for step in range(steps):
            batch = data.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "key"), F.lit(steps)) == step)
            loss, gradient, weight = _gradient(batch, net, buckets)
            losses.append(loss)
            weights.append(weight)
            gradient *= min(1.0, CLIP / max(float(np.linalg.norm(gradient)), 1e-12))
            at = epoch * steps + step
            now = rate_at(at, epochs * steps, rate)
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            move = first / (1 - 0.9 ** (at + 1)) / (np.sqrt(second / (1 - 0.999 ** (at + 1))) + 1e-8)
            values = values - now * (move + DECAY * values)
            net = net.from_flat(values)
        loss, accuracy, f1 = _validated(held, net, buckets, classes)
        if not history or f1 > max(h["macro_f1"] for h in history):
            best = net
        history.append({"epoch": epoch, "train_loss": float(np.average(losses, weights=weights)) if sum(weights) else 0.0, "validation_loss": loss, "accuracy": accuracy, "macro_f1": f1})
    return best, history


def predict(rows: DataFrame, net: Net, buckets: int = BUCKETS) -> DataFrame:
    """(key, pred) of inputs rows."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    kind = rows.schema["key"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for part, x in _chunks(batch, buckets, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.forward(x)[1].argmax(1), pa.int32())], names=["key", "pred"])

    return rows.select("key", "terms", "numbers").mapInArrow(work, f"key {kind}, pred int")


def curve(rows: DataFrame, history: list[dict]) -> DataFrame:
    """(epoch, metric, value) of a training history; rows only names the session."""
    return rows.sparkSession.createDataFrame([(h["epoch"], m, float(v)) for h in history for m, v in h.items() if m != "epoch"], "epoch int, metric string, value double")


def fit_fused(train_rows: DataFrame, text: str, key: str, numbers: list[str], classes: int, **settings) -> tuple[Net, DataFrame, list[dict]]:
    """(net, statistics of the number columns, history): a tenth of the training rows, by hash, chooses the epoch."""
    from prooflake.operators.sampling import validation_split

    split = stored(validation_split(train_rows.select(key, text, "label", *numbers), key), "fused-rows")
    own = split.where("split = 'train'")
    stats = stored(normalizer(own, numbers), "normalizer")
    given = [inputs(split.where(F.col("split") == s), text, key, numbers, stats, settings.get("buckets", BUCKETS)) for s in ("train", "validation")]
    net, history = train(*given, classes, len(numbers), **settings)
    return net, stats, history
