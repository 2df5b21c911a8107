"""Session defaults for scripts and tests; queries themselves take whatever session they are given."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "prooflake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and bounded Arrow batches. Shuffle partitions follow the local cores unless given."""
    cores = os.environ.get("BENCH_CPUS", "8")
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": cores,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.appName(app).master(master or f"local[{cores}]")
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
