"""Similarity thresholds as classifiers: a sweep of binary ones, quartiles, and the better of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prooflake.operators.metrics import confusion, macro
from prooflake.operators.quantiles import quantiles

STEPS = 100


def binary_sweep(rows: DataFrame, score: str = "score", true: str = "true") -> DataFrame:
    """(step, threshold, macro_f1) for thresholds 0.00 to 0.99, predicting 0 at or over it and 1 below.

    A row is counted once, in the interval of its score; running sums over 101 intervals give every threshold's confusion.
    """
    # thresholds are k / 100 as doubles; the interval is that of the last one not above the score
    near = F.least(F.greatest(F.floor(F.col(score) * STEPS).cast("int"), F.lit(-1)), F.lit(STEPS - 1))
    last = F.when((near < STEPS - 1) & (F.col(score) >= (near + 1) / F.lit(float(STEPS))), near + 1).when((near >= 0) & (F.col(score) < near / F.lit(float(STEPS))), near - 1).otherwise(near)
    counts = rows.groupBy(F.col(true).alias("true"), last.alias("last")).agg(F.count("*").alias("n"))
    steps = rows.sparkSession.range(STEPS).select(F.col("id").cast("int").alias("step"))
    # at most 101 intervals a label, against 100 thresholds
    tables = F.broadcast(steps).crossJoin(counts).groupBy("step", "true", F.when(F.col("last") >= F.col("step"), 0).otherwise(1).alias("pred")).agg(F.sum("n").alias("n"))
    return macro(tables, ["step"]).select("step", (F.col("step") / F.lit(float(STEPS))).alias("threshold"), "macro_f1")


def best_binary(sweep: DataFrame) -> DataFrame:
    """The first threshold with the highest score; 0.5 with 0 where none scores over 0."""
    best = sweep.where("macro_f1 > 0").agg(F.max_by("threshold", F.struct("macro_f1", -F.col("step"))).alias("t"), F.max("macro_f1").alias("f"))
    return best.select(F.coalesce("t", F.lit(0.5)).alias("threshold"), F.coalesce("f", F.lit(0.0)).alias("macro_f1"))


def quartiles(rows: DataFrame, score: str = "score") -> DataFrame:
    """One row: low, middle and high; none without scores."""
    return quantiles(rows, [], score, [0.25, 0.5, 0.75]).select(*(F.col("q")[k].alias(name) for k, name in enumerate(("low", "middle", "high"))))


def by_quartile(rows: DataFrame, score: str = "score") -> DataFrame:
    """rows with pred: 0 from the upper quartile on, 1 from the median, 2 from the lower quartile, else 3."""
    cut = rows.crossJoin(F.broadcast(quartiles(rows, score)))
    pred = F.when(F.col(score) >= F.col("high"), 0).when(F.col(score) >= F.col("middle"), 1).when(F.col(score) >= F.col("low"), 2).otherwise(3)
    return cut.withColumn("pred", pred).drop("low", "middle", "high")


def strategy(rows: DataFrame, score: str = "score", true: str = "true") -> DataFrame:
    """(strategy, threshold, binary_f1, quartile_f1): the binary threshold only where it is strictly better. Both are tuned on the rows they judge."""
    binary = best_binary(binary_sweep(rows, score, true)).select("threshold", F.col("macro_f1").alias("binary_f1"))
    multi = macro(confusion(by_quartile(rows, score), true)).select(F.col("macro_f1").alias("quartile_f1"))
    both = binary.crossJoin(multi)
    return both.select(F.when(F.col("binary_f1") > F.col("quartile_f1"), "binary_threshold").otherwise("multi_threshold").alias("strategy"), "threshold", "binary_f1", "quartile_f1")


def score_statistics(rows: DataFrame, by: str, score: str = "score") -> DataFrame:
    middle = quantiles(rows, [by], score, [0.5]).select(F.col(by).alias("_by"), F.col("q")[0].alias("median"))
    stats = rows.groupBy(by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count("*").alias("n"))
    return stats.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "mean", "std", "median", "n")
