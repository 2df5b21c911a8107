"""Batch scoring by a pluggable model: each different prompt or pair of texts is scored once, then what the model gave is joined back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prooflake.functions import responses as R
from prooflake.storage import scratch

#: A model: responses of a list of prompts. It is made once in each worker by the factory given to score().
Scorer = Callable[[list[str]], list[str]]
Factory = Callable[[], Scorer]
#: A model of pairs of texts: a row of numbers (logits) for each of a list of pairs.
PairScorer = Callable[[list[tuple[str, str]]], Sequence[Sequence[float]]]
PairFactory = Callable[[], PairScorer]
#: Stored responses: the model's name, the SHA-256 of the prompt, the response.
RESPONSES = "key string, response string, model string"


def _responder(factory: Factory, batch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(anything, prompt) -> (the same, response)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for part in batches:
            prompts = part.column(1).to_pylist()
            found = [r for at in range(0, len(prompts), batch) for r in model(prompts[at : at + batch])]
            if len(found) != len(prompts):
                raise ValueError(f"{len(found)} responses to {len(prompts)} prompts")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], names=["key", "response"])

    return work


def score(rows: DataFrame, prompt: str, factory: Factory, output: str = "response", batch: int = 32) -> DataFrame:
    """rows with the model's response to their prompt (null prompts have none)."""
    distinct = rows.select(F.col(prompt).alias("key")).where("key IS NOT NULL").distinct().withColumn("prompt", F.col("key"))
    answers = distinct.mapInArrow(_responder(factory, batch), "key string, response string").toDF("_prompt", output)
    return rows.join(answers, rows[prompt] == answers["_prompt"], "left").drop("_prompt")


def score_pairs(rows: DataFrame, first: str, second: str, factory: PairFactory, output: str = "logits", width: int = 3, batch: int = 32) -> DataFrame:
    """rows with `width` numbers for the pair of two text columns, a null one counting as empty. A model that gives another number of rows
    or of numbers is an error, as its numbers would belong to other pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                found = np.asarray(model(list(zip(*(c.to_pylist() for c in some.columns), strict=True))), np.float64)
                if found.shape != (some.num_rows, width):
                    raise ValueError(f"numbers of shape {found.shape} for {some.num_rows} pairs of {width}")
                numbers = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, width), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, numbers], names=["_a", "_b", output])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    distinct = rows.select(text(first).alias("_a"), text(second).alias("_b")).distinct()
    numbers = distinct.mapInArrow(work, f"_a string, _b string, `{output}` array<double>")
    return rows.join(numbers, (text(first) == F.col("_a")) & (text(second) == F.col("_b")), "left").drop("_a", "_b")


def responses(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """(key, response) of a model's stored responses, one a prompt: of several that runs at the same time have stored, the least."""
    try:
        found = spark.read.schema(RESPONSES).parquet(folder).where(F.col("model") == model)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], RESPONSES)
    return found.groupBy("key").agg(F.min("response").alias("response"))


def respond(rows: DataFrame, prompt: str, factory: Factory, folder: str, model: str, output: str = "response", batch: int = 32, slices: int = 16) -> DataFrame:
    """rows with the model's response to their prompt (null prompts have none), scoring only prompts without a stored response.

    Responses are kept in `folder` by the model's name and the prompt's SHA-256. New ones are stored in `slices` slices of the keys, each a
    job that commits as a whole: a run that dies keeps the slices it finished, and a rerun scores what is left.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.sha2(F.col(prompt), 256))
    new = keyed.where("_key IS NOT NULL").select(F.col("_key").alias("key"), F.col(prompt).alias("prompt")).join(responses(spark, folder, model), "key", "left_anti").dropDuplicates(["key"])
    place = f"{scratch(spark)}/prooflake/prompts-{uuid.uuid4().hex}"
    new.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")).write.partitionBy("slice").parquet(place)
    left = spark.read.schema("key string, prompt string, slice int").parquet(place)
    for (k,) in sorted(tuple(r) for r in left.select("slice").distinct().collect()):  # at most `slices` numbers
        found = left.where(F.col("slice") == k).select("key", "prompt").mapInArrow(_responder(factory, batch), "key string, response string")
        found.withColumn("model", F.lit(model)).write.mode("append").partitionBy("model").parquet(folder)
    answers = responses(spark, folder, model).select(F.col("key").alias("_known"), F.col("response").alias(output))
    return keyed.join(answers, F.col("_key") == F.col("_known"), "left").drop("_key", "_known")


def generate(rows: DataFrame, dataset: str, evidence: str, factory: Factory, folder: str, model: str, output: str = "answer", claims: tuple[str, ...] = ("fever",)) -> DataFrame:
    """rows with the model's cleaned answer (or verdict on claims) from their evidence, by stored responses."""
    asked = rows.withColumn("_ask", R.generation_prompt(dataset, evidence, claims))
    said = respond(asked, "_ask", factory, folder, model, "_said")
    return said.withColumn(output, R.clean_answer("_said")).drop("_ask", "_said")
