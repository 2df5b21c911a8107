"""What the operators share: bounded Arrow batches and column names; scratch tables and running sums are the package's own."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from prooflake.storage import running, scratch, stored, used_up

__all__ = ["WORD", "positional", "release", "running", "runs", "scratch", "stored", "table", "texts_of", "used_up"]

#: Words are maximal runs of bytes other than space and 0x09-0x0D, which is what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns c0, c1, ... and the new name of each old one. Whatever the columns are called, none then clashes
    with those that an operator adds; toDF(*docs.columns) gives the names back."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps. Spark removes them once the driver's garbage is collected, which on a driver
    with little to do may be long after the disk is needed. No result depends on it; where the call isn't there, nothing happens."""
    gc.collect()
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string or binary column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def runs(batches: Iterable[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches (Spark bounds them by spark.sql.execution.arrow.maxBytesPerBatch) so that none holds more than about most_bytes,
    save a single longer row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, most_bytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
