"""Classification metrics: everything is computed from the confusion table, a few rows whatever the input's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prooflake.functions.vocabulary import ACTIONS, STATES
from prooflake.storage import running


def confusion(rows: DataFrame, true: str = "true", pred: str = "pred", by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., true, pred, n)."""
    return rows.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_report(table: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., label, precision, recall, f1, support) of the labels that occur as true or predicted; 0 where nothing is to divide."""
    sides = table.select(*by, F.col("true").alias("label"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.unionByName(table.select(*by, F.col("pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")))
    sums = sides.groupBy(*by, "label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hit"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.greatest(F.col(whole), F.lit(1))).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("predicted") > 0, 2.0 * F.col("hit") / F.greatest(F.col("support") + F.col("predicted"), F.lit(1))).otherwise(0.0)
    return sums.select(*by, "label", share("hit", "predicted").alias("precision"), share("hit", "support").alias("recall"), f1.alias("f1"), "support")


def macro(table: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., accuracy, macro_precision, macro_recall, macro_f1, n); labels are those of each group."""
    means = class_report(table, by).groupBy(*by).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    hits = table.groupBy(*by).agg((F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    return hits.join(means, by) if by else hits.crossJoin(means)


def state_name(state: str):
    return F.element_at(F.array(*(F.lit(s) for s in STATES)), F.col(state) + 1)


def action_name(state: str):
    return F.element_at(F.array(*(F.lit(a) for a in ACTIONS)), F.col(state) + 1)


def majority(train: DataFrame, label: str, order: str) -> DataFrame:
    """(majority): the most frequent label, of equal ones the one seen first."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).select(F.col(label).alias("majority"))


def running_confusion(rows: DataFrame, ordinal: str, true: str, pred: str, labels: list[int], every: int = 100) -> DataFrame:
    """(rows_seen, c_<true>_<pred>...) after every `every` rows in order: counts of each stretch, then two-level running sums over stretches."""
    cells = [(t, p) for t in labels for p in labels]
    stretch = F.floor(F.col(ordinal) / every).alias("stretch")
    counts = rows.groupBy(stretch).agg(F.count("*").alias("n"), *(F.count_if((F.col(true) == t) & (F.col(pred) == p)).alias(f"n_{t}_{p}") for t, p in cells))
    seen = running(counts, [F.col("stretch")], {"r": F.col("n")} | {f"r_{t}_{p}": F.col(f"n_{t}_{p}") for t, p in cells})
    return seen.where(F.col("n") == every).select((F.col("r") + F.col("n")).alias("rows_seen"), *((F.col(f"r_{t}_{p}") + F.col(f"n_{t}_{p}")).alias(f"c_{t}_{p}") for t, p in cells))


def running_accuracy(rows: DataFrame, ordinal: str, true: str, pred: str, every: int = 100, labels: list[int] = [0, 1, 2, 3]) -> DataFrame:  # noqa: B006
    """(rows_seen, accuracy) after every `every` rows in order."""
    hits = sum((F.col(f"c_{t}_{t}") for t in labels), F.lit(0))
    return running_confusion(rows, ordinal, true, pred, labels, every).select("rows_seen", (hits / F.col("rows_seen")).alias("accuracy"))


def running_macro_f1(rows: DataFrame, ordinal: str, true: str, pred: str, every: int = 100, labels: list[int] = [0, 1, 2, 3]) -> DataFrame:  # noqa: B006
    """(rows_seen, macro_f1) after every `every` rows in order, over the labels seen so far as true or predicted."""
    f1 = []
    for k in labels:
        both = sum((F.col(f"c_{k}_{o}") + F.col(f"c_{o}_{k}") for o in labels), F.lit(0))
        f1.append(F.when(both > 0, 2.0 * F.col(f"c_{k}_{k}") / F.greatest(both, F.lit(1))))
    found = F.filter(F.array(*f1), lambda x: x.isNotNull())
    mean = F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.size(found)
    return running_confusion(rows, ordinal, true, pred, labels, every).select("rows_seen", mean.alias("macro_f1"))
