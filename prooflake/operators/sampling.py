"""Seeded sampling, balancing and splitting by hash rank: exact sizes, whatever the partitioning. Keys are distinct.

Where a class, or a stratum, gives up a number of rows, the rank and key of the last row that it gives are found first (`bounds`): ranks
are counted by their upper half, of which there are 65,536, and only rows of the one bin that holds the bound are put in order. The
rows themselves are then told apart by a comparison, so wide rows are neither sorted nor shuffled, and no task gets a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prooflake.functions.text import hash_rank
from prooflake.storage import running


def _rank(stream: str, key: str) -> list[Column]:
    return [hash_rank(stream, F.col(key)), F.col(key)]


def bounds(rows: DataFrame, by: list[str], key: str, stream: str, wanted: Column) -> DataFrame:
    """(by..., _rank, _key, _n): of each group (n rows, in column _n) the wanted-th row by rank and key; groups that give none are left out."""
    narrow = rows.select(*(F.col(b).alias(f"_by{k}") for k, b in enumerate(by)), hash_rank(stream, F.col(key)).alias("_rank"), F.col(key).alias("_key"))
    groups, bin_ = [f"_by{k}" for k in range(len(by))], F.floor(F.col("_rank") / 65536).alias("_bin")
    counts = narrow.groupBy(*groups, bin_).agg(F.count("*").alias("_m"))
    before = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).withColumn("_n", F.sum("_m").over(Window.partitionBy(*groups)))
    cut = sums.withColumn("_want", wanted).where("_before < _want AND _want <= _before + _m")
    cut = cut.select(*(F.col(g).alias(f"{g}_") for g in groups), F.col("_bin").alias("_cut"), (F.col("_want") - F.col("_before")).alias("_place"), "_n")
    same = F.col("_bin") == F.col("_cut")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    inside = narrow.withColumn("_bin", F.floor(F.col("_rank") / 65536)).join(cut, same)
    order = F.row_number().over(Window.partitionBy(*groups).orderBy("_rank", "_key"))
    return inside.withColumn("_at", order).where("_at = _place").select(*groups, F.col("_rank").alias("_b_rank"), F.col("_key").alias("_b_key"))


def _up_to(rows: DataFrame, by: list[str], key: str, stream: str, wanted: Column) -> DataFrame:
    """rows with `_in`: whether a row is among the wanted first ones of its group by rank and key."""
    found = bounds(rows, by, key, stream, wanted)
    same = F.lit(True)
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{k}"))
    rank, own = hash_rank(stream, F.col(key)), F.col(key)
    first = (rank < F.col("_b_rank")) | (rank == F.col("_b_rank")) & (own <= F.col("_b_key"))
    return rows.join(found, same, "left").withColumn("_in", F.coalesce(first, F.lit(False))).select(*rows.columns, "_in")


def seeded_sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement. A top-n by hash: every task keeps n rows at most before they meet."""
    return rows.orderBy(*_rank(f"{seed}|sample", key)).limit(n)


def balanced(rows: DataFrame, label: str, key: str, labels: list[str], seed: int = 42) -> DataFrame:
    """Each class cut to the size of the smallest; 0 rows if a class is missing."""
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isin(labels)).groupBy(label).count().collect()}  # a closed vocabulary
    least = min(counts.get(x, 0) for x in labels)
    return _up_to(rows, [label], key, f"{seed}|balance", F.lit(least)).where("_in").drop("_in")


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(*_rank(f"{seed}|shuffle", key))


def shuffled_places(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """rows with `place`, their number from 0 in the shuffled order."""
    return running(rows, _rank(f"{seed}|shuffle", key), {"place": F.lit(1)})


def stratified_split(rows: DataFrame, strata: list[str], key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with `split`: of each stratum the first max(1, floor(n * share)) rows by hash are test, the rest train."""
    wanted = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(test_share)))
    return _up_to(rows, strata, key, f"{seed}|split", wanted).withColumn("split", F.when(F.col("_in"), "test").otherwise("train")).drop("_in")


def validation_split(rows: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """rows with `split`: max(1, floor(n * share)) rows by hash are validation."""
    wanted = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))
    return _up_to(rows, [], key, f"{seed}|validation", wanted).withColumn("split", F.when(F.col("_in"), "validation").otherwise("train")).drop("_in")


#: Datasets that may be held out in turn, as each copies the table once; more are an error.
MOST_DATASETS = 1000


def names_of(rows: DataFrame, dataset: str) -> list:
    """The different values of a column of few names, in order; more than MOST_DATASETS are an error."""
    names = [r[0] for r in rows.select(dataset).distinct().orderBy(dataset).limit(MOST_DATASETS + 1).collect()]
    if len(names) > MOST_DATASETS:
        raise ValueError(f"more than {MOST_DATASETS} datasets in {dataset}")
    return names


def held_out_by(rows: DataFrame, dataset: str) -> DataFrame:
    """Each row once for each dataset: as test where that dataset is held out, else as train."""
    names = names_of(rows, dataset)
    if not names:
        return rows.select("*", F.col(dataset).alias("held_out"), F.lit("test").alias("split"))
    each = rows.withColumn("held_out", F.explode(F.array(*(F.lit(n) for n in names))))
    return each.withColumn("split", F.when(F.col(dataset).eqNullSafe(F.col("held_out")), "test").otherwise("train"))


def folds(rows: DataFrame, label: str, key: str, n: int = 5) -> DataFrame:
    """rows with `fold`: round robin within each class, in key order. Only keys and labels are put in order."""
    placed = running(rows.select(F.col(key).alias("_key"), F.col(label).alias("_label")), [F.col("_key")], {"_place": F.lit(1)}, ["_label"])
    fold = placed.select("_key", (F.col("_place") % n).cast("int").alias("fold"))
    return rows.join(fold, rows[key] == fold["_key"]).drop("_key")


def with_places(rows: DataFrame, key: str) -> DataFrame:
    """rows with `place`, their number from 0 in key order. Ranges of the key are counted first, so no task sorts all rows."""
    return running(rows, [F.col(key)], {"place": F.lit(1)})
