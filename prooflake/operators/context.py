"""Five metrics of retrieved context against a question and a gold answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prooflake.functions import text as T
from prooflake.functions.vocabulary import STOPWORDS_CONTEXT

METRICS = ["context_precision", "context_recall", "context_relevancy", "context_utilization", "answer_coverage"]


def context_metrics(rows: DataFrame, question: str = "question", passages: str = "passages", gold: str = "gold") -> DataFrame:
    """rows with context_precision, context_recall, context_relevancy, context_utilization, answer_coverage; all 0 without passages."""
    sets = F.transform(passages, lambda p: F.array_distinct(T.plain_tokens(p)))
    prepared = rows.withColumn("_p", sets).withColumn("_g", F.array_distinct(T.plain_tokens(gold))).withColumn("_q", T.content(F.array_distinct(T.plain_tokens(question)), STOPWORDS_CONTEXT))
    n, g, q = F.size("_p"), F.col("_g"), F.col("_q")
    mean = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.greatest(n, F.lit(1))
    covered = F.transform("_p", lambda p: T.ratio(F.size(F.array_intersect(g, p)), F.size(g)))
    some = lambda value: F.when((n > 0) & (F.size(g) > 0), value).otherwise(0.0)
    overlap = lambda p: T.query_overlap(q, T.content(p, STOPWORDS_CONTEXT))
    found: dict[str, Column] = {
        "context_precision": some(T.ratio(F.size(F.filter("_p", lambda p: F.arrays_overlap(p, g))), n)),
        "context_recall": some(T.ratio(F.size(F.array_intersect(g, F.flatten("_p"))), F.size(g))),
        "context_relevancy": F.when((n > 0) & (F.size(q) > 0), mean(F.transform("_p", overlap))).otherwise(0.0),
        "context_utilization": F.when(n > 0, T.ratio(F.size(F.filter(passages, lambda p: F.length(T.strip(p)) > 10)), n)).otherwise(0.0),
        "answer_coverage": some(F.coalesce(F.array_max(covered), F.lit(0.0))),
    }
    return prepared.withColumns(found).drop("_p", "_g", "_q")
