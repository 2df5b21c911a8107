"""Pairs of an instance's units whose token sets are similar: they meet inside the instance's row, so nothing is shuffled and only pairs
over the threshold become rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prooflake.operators import graph
from prooflake.operators.similarity import measured, words_of


def similar_pairs(instances: DataFrame, threshold: float, key: str = "example_id", words: bool = False) -> DataFrame:
    """(key, i, j, src, dst, similarity) of the pairs of units i < j with a Jaccard similarity over the threshold.
    words: as in features.with_features."""
    return graph.similar_units(instances, threshold, key, words)


def duplicate_rates(instances: DataFrame, threshold: float, key: str = "example_id", words: bool = False) -> DataFrame:
    """(key, n, duplicates, duplicate_rate): units with text, and the share of their pairs that are over the threshold."""
    told = instances.select(key, measured(words_of("evidence_units", words), F.array().cast("array<string>"), threshold).alias("told"))
    found = told.select(key, F.col("told.n").alias("n"), F.col("told.similar").cast("int").alias("duplicates"))
    return with_rate(found)


def with_rate(found: DataFrame) -> DataFrame:
    """found (n, duplicates) with the share of the pairs."""
    return found.withColumn("duplicate_rate", F.col("duplicates") / F.greatest(F.col("n").cast("long") * (F.col("n") - 1) / 2, F.lit(1.0)))
