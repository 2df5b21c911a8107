"""Scratch tables that every executor sees, and running sums over a global order."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only where that is unset and all runs on one machine (as in tests) a temporary
    one is made; on a cluster that is an error, as other machines wouldn't see it."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="prooflake-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


#: Batches that go to Python workers while a table is stored: with long texts larger ones would not fit beside two workers.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextmanager
def set_for_a_while(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/prooflake/{name}-{uuid.uuid4().hex}"
    with set_for_a_while(spark, SMALL_BATCHES):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PLACES[back] = path
    return back


def used_up(*tables: DataFrame) -> None:
    """Empty stored tables once all that was made of them is itself stored, so that scratch space doesn't add up over the steps."""
    for df in tables:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(_PLACES.pop(df))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] = []) -> DataFrame:  # noqa: B006
    """rows with a column for each of sums: its total over all rows (of the same `by`) that stand before in the order, ties in any order.

    Two levels: rows are dealt to ranges of the order, and the totals of earlier ranges are added to the sums inside a range. So a task
    sorts one range, and a single one only sees a row per range (and group).
    """
    placed = stored(rows.withColumns({f"_{k}": c.cast("long") for k, c in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = placed.groupBy("_range", *by).agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in sums))
    bases = totals.select(F.col("_range").alias("__range"), *(F.col(b).alias(f"__by_{b}") for b in by), *(F.coalesce(F.sum(f"_{k}").over(earlier), zero).alias(f"__base_{k}") for k in sums))
    local = placed.withColumns({k: F.coalesce(F.sum(f"_{k}").over(inside), zero) for k in sums})
    same = F.col("_range") == F.col("__range")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    joined = local.join(bases if by else F.broadcast(bases), same)  # without groups one row a range, and ranges are as many as shuffle partitions
    return joined.select(*rows.columns, *((F.col(k) + F.col(f"__base_{k}")).alias(k) for k in sums))
