"""Remediation: questions with their sufficient variant, answers under three conditions, and their summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prooflake.functions import text as T


def question_groups(variants: DataFrame, question: str = "input_text", state: str = "state", order: str = "ordinal", fields: list[str] = []) -> DataFrame:  # noqa: B006
    """(question, sufficient: the last sufficient variant's fields, n_variants, n_states, complete) of the questions that have one."""
    last = F.max_by(F.struct(order, *fields), F.when(F.col(state) == "sufficient", F.col(order)))
    groups = variants.groupBy(question).agg(last.alias("sufficient"), F.count("*").alias("n_variants"), F.count_distinct(state).alias("n_states"), F.max(F.col(state) == "sufficient").alias("_has"))
    return groups.where("_has").drop("_has").withColumn("complete", F.col("n_states") == 4)


def evaluation_rows(variants: DataFrame, question: str, state: str, order: str, evidence: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """Each question's last sufficient variant and its other variants, with the sufficient one's evidence beside their own, and its fields as
    sufficient_<field>."""
    groups = question_groups(variants, question, state, order, [evidence, *fields])
    theirs = [F.col(f"sufficient.{c}").alias(f"sufficient_{c}") for c in fields]
    paired = variants.join(groups.select(question, F.col(f"sufficient.{order}").alias("_last"), F.col(f"sufficient.{evidence}").alias("sufficient_evidence"), *theirs), question)
    return paired.where((F.col(state) != "sufficient") | (F.col(order) == F.col("_last"))).drop("_last")


def swapped(evidence: Column | str, sufficient_evidence: Column | str, is_sufficient: Column) -> Column:
    """The row's own evidence where it is taken as sufficient, else that of the sufficient variant."""
    return F.when(is_sufficient, T._col(evidence)).otherwise(T._col(sufficient_evidence))


def with_answers(rows: DataFrame, answer: Callable[[DataFrame, str, str, str], DataFrame], state: str = "state", predicted: str = "predicted") -> DataFrame:
    """Evaluation rows (evidence, sufficient_evidence, sufficient_dataset, sufficient_target_answer, sufficient_target_label) with `gold`, the answers
    of three conditions and `detector_correct`.

    answer(rows, dataset, evidence, output) adds the model's answer from an evidence column. Every row answers from its own evidence and from the sufficient
    variant's; the conditions only choose between the two. A question without an answer or label has the answer from its sufficient evidence as gold.
    """
    both = answer(answer(rows, "sufficient_dataset", "evidence", "_own"), "sufficient_dataset", "sufficient_evidence", "_best")
    taken = lambda c: swapped("_own", "_best", F.col(c) == "sufficient")
    gold = T.first_filled("sufficient_target_answer", "sufficient_target_label", "_best")
    told = both.withColumns({"gold": gold, "naive_answer": F.col("_own"), "guided_answer": taken(predicted), "oracle_answer": taken(state)})
    return told.withColumn("detector_correct", F.col(predicted).eqNullSafe(F.col(state))).drop("_own", "_best")


def scored_conditions(rows: DataFrame, gold: str = "gold", conditions: tuple[str, ...] = ("naive", "guided", "oracle")) -> DataFrame:
    """rows with f1_<condition> and em_<condition> of the answers <condition>_answer."""
    new = {}
    for c in conditions:
        new |= {f"f1_{c}": T.token_f1(f"{c}_answer", gold), f"em_{c}": T.exact_match(f"{c}_answer", gold)}
    return rows.withColumns(new)


def summary(rows: DataFrame, by: list[str], conditions: tuple[str, ...] = ("naive", "guided", "oracle")) -> DataFrame:
    """Means of all scores overall and by each column of `by`, in one pass over grouping sets; improvement and recovered share of the gap."""
    means = [F.avg(f"{m}_{c}").alias(f"{m}_{c}") for m in ("f1", "em") for c in conditions]
    sets = [[]] + [[F.col(c)] for c in by]
    grouped = rows.groupingSets(sets, *(F.col(c) for c in by)).agg(F.count("*").alias("n"), F.avg(F.col("detector_correct").cast("double")).alias("detector_accuracy"), *means, *(F.grouping(c).alias(f"_{c}") for c in by))
    level = F.lit("overall")
    for c in by:
        level = F.when(F.col(f"_{c}") == 0, c).otherwise(level)
    gap = F.col("f1_oracle") - F.col("f1_naive")
    gain = F.col("f1_guided") - F.col("f1_naive")
    value = F.coalesce(*(F.col(c).cast("string") for c in by), F.lit("all"))
    out = grouped.withColumn("level", level).withColumn("value", value).withColumn("improvement", gain).withColumn("oracle_gap", gap).withColumn("recovery", F.when(gap > 0, 100 * gain / F.nullif(gap, F.lit(0.0))).otherwise(0.0))
    return out.select("level", "value", "n", "detector_accuracy", *(f"{m}_{c}" for m in ("f1", "em") for c in conditions), "improvement", "oracle_gap", "recovery")
