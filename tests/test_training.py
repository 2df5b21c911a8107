"""Fits of all folds at once, and the training loop, against numpy and against single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prooflake.operators import folds, models, training
from prooflake.plans import catalog


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    y = rng.choice([0, 1, 2], 400, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(400, 3)) * [1, 50, 0.1] + y[:, None] * [0.7, 10, -0.05]
    return spark.createDataFrame([(int(k % 4), int(a), *map(float, b)) for k, (a, b) in enumerate(zip(y, x, strict=True))], "fold int, label int, x double, y double, z double").repartition(5).cache()


def test_all_folds_equal_single_fits(spark, rows, monkeypatch):
    columns = ["x", "y", "z"]
    calls = []
    monkeypatch.setattr(folds, "summed", lambda data, measure, f=folds.summed: calls.append(1) or f(data, measure))
    found, passes = folds.fit_folds(rows, columns)
    assert [m.left_out for m in found] == [-1, 0, 1, 2, 3] and len(calls) == passes < 15
    for m in found[:3]:
        alone, _ = folds.fit_folds(rows.where(F.col("fold") != m.left_out), columns)
        assert np.allclose(alone[0].weights, m.weights, atol=1e-6) and np.allclose(alone[0].mean, m.mean) and alone[0].left_out == -1
    # the objective is that of the regression of pyspark.ml, whose search stops earlier
    fitted = models.fit_detector(rows.where("fold <> 1"), columns).model
    own = found[2].weights
    assert np.allclose(fitted.coefficientMatrix.toArray(), own[:-1].T, atol=2e-3)
    assert np.allclose(fitted.interceptVector.toArray() - fitted.interceptVector.toArray().mean(), own[-1] - own[-1].mean(), atol=2e-3)


def test_passes_do_not_grow_with_the_folds(spark, rows):
    columns = ["x", "y"]
    few, many = (folds.fit_folds(rows.withColumn("fold", (F.abs(F.hash("x")) % n)), columns)[1] for n in (2, 25))
    assert many <= few + 1


def test_folds_without_a_class_or_with_nulls(spark):
    data = [(0, 0, 1.0), (0, 0, None), (1, 0, 2.0), (1, 1, 5.0), (1, 1, 6.0), (0, 0, 0.5)]
    df = spark.createDataFrame(data, "fold int, label int, x double")
    found, _ = folds.fit_folds(df, ["x"])
    assert [m.classes for m in found] == [[0, 1], [0, 1], [0]]
    judged = folds.judged(df, ["x"], found)
    assert {r.pred for r in judged.where("fold = 1").collect()} == {0} and judged.where("fold = -1").count() == len(data)
    with pytest.raises(ValueError, match="parameters"):
        folds.fit_folds(df.select("*", *(F.col("x").alias(f"x{k}") for k in range(300))), [f"x{k}" for k in range(300)])


def separated(spark, n=240):
    words = ["alpha beta", "gamma delta", "omega psi"]
    return spark.range(n).select(F.col("id"), (F.col("id") % 3).cast("int").alias("label"), F.concat(F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 3 + 1).cast("int")), F.lit(" common words")).alias("text"), (F.col("id") % 7).cast("double").alias("u"))


def test_training_history_and_best_epoch(spark, monkeypatch):
    data = separated(spark)
    net, stats, history = training.fit_fused(data, "text", "id", ["u"], 3, buckets=64, hidden=6, epochs=3, steps=3, rate=0.1)
    assert [h["epoch"] for h in history] == [0, 1, 2] and history[-1]["train_loss"] < history[0]["train_loss"]
    given = training.inputs(data, "text", "id", ["u"], stats, 64)
    pred = {r.key: r.pred for r in training.predict(given, net, 64).collect()}
    # a forward pass in numpy over the same vectors
    local = given.orderBy("key").collect()
    x = training.dense([r.terms for r in local], [r.numbers for r in local], 64)
    wanted = (np.tanh(x @ net.w1 + net.b1) @ net.w2 + net.b2).argmax(1)
    assert [pred[r.key] for r in local] == wanted.tolist()
    assert np.mean(wanted == [r.label for r in local]) > 0.95
    # of equal epochs the first is best
    scores = iter([0.5, 0.9, 0.9])
    monkeypatch.setattr(training, "_validated", lambda *_: (0.0, 0.0, next(scores)))
    seen = []
    monkeypatch.setattr(training, "_gradient", lambda rows, net, buckets: seen.append(net) or (0.0, np.ones_like(net.flat()), 1.0))
    best, _ = training.train(given, given, 3, 1, 64, 2, epochs=3, steps=1)
    assert best is seen[2]


def test_gradient_equals_differences():
    rng = np.random.default_rng(5)
    for hidden in (0, 4):
        net = training.new_net(5, hidden, 3).from_flat(rng.normal(size=training.new_net(5, hidden, 3).flat().size))
        x, y, w = rng.normal(size=(7, 5)), rng.integers(0, 3, 7), rng.uniform(0.5, 2, 7)
        flat, (_, gradient) = net.flat(), net.backward(x, y, w)
        for k in range(len(flat)):
            step = np.zeros_like(flat)
            step[k] = 1e-6
            slope = (net.from_flat(flat + step).backward(x, y, w)[0] - net.from_flat(flat - step).backward(x, y, w)[0]) / 2e-6
            assert slope == pytest.approx(gradient[k], rel=1e-4, abs=1e-6)


def test_rate_rises_and_falls():
    rates = [training.rate_at(k, 40, 1.0) for k in range(40)]
    assert rates[:4] == [0.25, 0.5, 0.75, 1.0] and rates[4:] == sorted(rates[4:], reverse=True) and rates[-1] == pytest.approx(1 / 36)


def test_linear_net_comes_near_the_closed_fit(spark, rows):
    """Without hidden units the loop minimises what the regression does, save the penalty."""
    stats = models.normalizer(rows, ["x", "y", "z"])
    given = training.inputs(rows.withColumn("id", F.monotonically_increasing_id()).withColumn("text", F.lit(None).cast("string")), "text", "id", ["x", "y", "z"], stats, 1)
    net, history = training.train(given, given, 3, 3, 1, 0, epochs=12, steps=2, rate=0.4)
    closed = folds.fit_folds(rows, ["x", "y", "z"])[0][0]
    local = given.collect()
    x = training.dense([r.terms for r in local], [r.numbers for r in local], 1)
    mine, other = net.forward(x)[1].argmax(1), np.hstack([x[:, 1:], np.ones((len(x), 1))]) @ closed.weights
    assert np.mean(mine == other.argmax(1)) > 0.9


def test_curve_and_fused_queries(spark):
    sf = "/root/testdata/sf0.001"
    curve = catalog.queries()["training_curve"](spark, sf).collect()
    assert {r.epoch for r in curve} == set(range(training.EPOCHS)) and {r.metric for r in curve} == {"train_loss", "validation_loss", "accuracy", "macro_f1"}
    table = catalog.queries()["fused_detector"](spark, sf).where("dataset = 'all'").first()
    assert table.n == catalog.queries()["detector_split"](spark, sf).where("split = 'test'").count() and 0 <= table.macro_f1 <= 1
    losses = [r.value for r in sorted(curve) if r.metric == "train_loss"]
    assert losses[-1] < losses[0]
