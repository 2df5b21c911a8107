"""The tables behind the figures; nothing is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prooflake.operators.quantiles import quantiles


def unpivoted(rows: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return rows.unpivot([F.col(k) for k in keys], [F.col(c).cast("double").alias(c) for c in columns], name, value)


def statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std, min, max) with the population deviation."""
    return unpivoted(rows, [], columns).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def state_means(rows: DataFrame, state: str, columns: list[str]) -> DataFrame:
    """(state, feature, mean, std) with the sample deviation."""
    return unpivoted(rows, [state], columns).groupBy(state, "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def scaled_means(rows: DataFrame, state: str, columns: list[str]) -> DataFrame:
    """(state, feature, scaled): the states' means between 0 and 1."""
    over = Window.partitionBy("feature")
    low, high = F.min("mean").over(over), F.max("mean").over(over)
    return state_means(rows, state, columns).select(state, "feature", ((F.col("mean") - low) / (high - low + 1e-8)).alias("scaled"))


def box_statistics(rows: DataFrame, state: str, columns: list[str]) -> DataFrame:
    """(state, feature, q1, median, q3, low, high): whiskers end at the last value within 1.5 interquartile ranges."""
    long = unpivoted(rows, [state], columns)
    quartiles = quantiles(long, [state, "feature"], "value", [0.25, 0.5, 0.75])
    joined = long.join(quartiles, [state, "feature"])
    q1, q3 = F.col("q")[0], F.col("q")[2]
    reach = 1.5 * (q3 - q1)
    ends = joined.groupBy(state, "feature").agg(F.first("q").alias("q"), F.min(F.when(F.col("value") >= q1 - reach, F.col("value"))).alias("low"), F.max(F.when(F.col("value") <= q3 + reach, F.col("value"))).alias("high"))
    return ends.select(state, "feature", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "low", "high")


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) of the lower triangle with its diagonal; null where a column doesn't vary. One aggregation for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[: i + 1]]
    r = lambda a, b: F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    cells = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r(a, b).alias("r")) for a, b in pairs))
    return rows.agg(cells.alias("c")).select(F.inline("c"))


def distribution(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts overall and by each column of `by`, in one pass: (level, value, n)."""
    grouped = rows.groupingSets([[], *([F.col(c)] for c in by)], *(F.col(c) for c in by)).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"_{c}") for c in by))
    level = F.lit("overall")
    for c in by:
        level = F.when(F.col(f"_{c}") == 0, c).otherwise(level)
    return grouped.select(level.alias("level"), F.coalesce(*(F.col(c).cast("string") for c in by), F.lit("all")).alias("value"), "n")


def class_pivot(rows: DataFrame, row: str, column: str, values: list[str], value: str | None = None) -> DataFrame:
    """One row per `row`, one column per value of `column`: counts (0 where missing), or means of `value`."""
    grouped = rows.groupBy(row).pivot(column, values)
    return grouped.agg(F.avg(value)) if value else grouped.count().na.fill(0, values)


#: The features shown by dataset and state.
KEY_FEATURES = ["entity_overlap", "text_resolution_rate", "duplicate_rate", "evidence_count"]


def key_feature_pivot(rows: DataFrame, dataset: str, state: str, states: list[str]) -> DataFrame:
    """(dataset, feature, mean of each state) of KEY_FEATURES."""
    return unpivoted(rows, [dataset, state], KEY_FEATURES).groupBy(dataset, "feature").pivot(state, states).agg(F.avg("value"))
