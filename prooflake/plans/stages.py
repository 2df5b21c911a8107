"""Restartable stages: a manifest of each says what it was made of, so that a rerun redoes only what isn't finished or has other inputs.

A stage reads folders, writes folders and has settings. When it ends, its manifest records the settings and the state of all these folders (their files'
names, sizes and times). It is skipped as long as that is unchanged. The manifest is struck out before a stage starts, so what a run
that died left half-written is never taken as finished, whatever the settings of the next run.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def state(spark: SparkSession, folder: str) -> str:
    """Number, size and a digest of the files in a folder and below; 'missing' if it isn't there. Contents are not read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return "missing"
    found = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")), F.lit(0)).alias("digest")).first()
    return f"{found.n} files, {found['size']} bytes, {found.digest}"


def _read(spark: SparkSession, path: str) -> str | None:
    try:
        lines = spark.read.text(path, wholetext=True).take(1)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return lines[0].value.rstrip("\n") if lines else None


def _write(spark: SparkSession, path: str, value: str) -> None:
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def once(spark: SparkSession, out: str, name: str, make: Callable[[], None], inputs: list[str], outputs: list[str], **settings: object) -> bool:
    """Run make() unless the stage's manifest in `out` holds for these settings and folders. True if it ran."""
    path = f"{out}/stages/{name}"
    now = lambda: json.dumps({"settings": settings, "inputs": {p: state(spark, p) for p in inputs}, "outputs": {p: state(spark, p) for p in outputs}}, sort_keys=True, default=str)
    if _read(spark, path) == now():
        return False
    _write(spark, path, "unfinished")
    make()
    _write(spark, path, now())
    return True
