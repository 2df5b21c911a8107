"""Model inputs: top-k evidence, structured and plain texts, feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prooflake.functions import text as T
from prooflake.functions.vocabulary import FEATURES, STOPWORDS_UNIT


def top_evidence(query: Column, texts: Column, k: int = 10, most: int = 300) -> Column:
    """The k passages (struct score, pos, text) that share most with the query, ties in order: stripped and cut before scoring."""
    asked = T.content(T.token_set(query), STOPWORDS_UNIT)
    cut = F.transform(F.filter(texts, lambda t: ~T.is_blank(t)), lambda t: T.head(T.strip(t), most))
    scored = F.transform(cut, lambda t, i: F.struct(_order(asked, t).alias("order"), i.alias("pos"), t.alias("text")))
    return F.transform(F.slice(F.array_sort(scored), 1, k), lambda s: F.struct((-s["order"]).alias("score"), s["pos"].alias("pos"), s["text"].alias("text")))


def _order(asked: Column, text: Column) -> Column:
    return -T.query_overlap(asked, T.content(T.token_set(text), STOPWORDS_UNIT))


def top_rows(units: DataFrame, queries: DataFrame, more: int = 1, k: int = 10, most: int = 300) -> DataFrame:
    """(key, top: the first k + more of top_evidence, as structs order, pos, uid, text) of units (key, uid, text) that are rows. queries: key, input_text."""
    cut = units.where(~T.is_blank("text")).select("key", "uid", T.head(T.strip("text"), most).alias("text"))
    asked = queries.select("key", T.content(T.token_set("input_text"), STOPWORDS_UNIT).alias("asked"))
    rows = cut.join(asked, "key").select("key", "uid", "text", _order(F.col("asked"), F.col("text")).alias("order"))
    first = rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("order", "uid"))).where(F.col("pos") <= k + more)
    return first.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("order", "pos", "uid", "text"))).alias("top"))


def plain_inputs(states: DataFrame, k: int = 10, most: int = 300) -> DataFrame:
    """states (input_text, top: of top_rows, gone: the uid of a unit that goes, new: a text that is added behind all; null: none) with the plain_input of processed()."""
    asked = T.content(T.token_set("input_text"), STOPWORDS_UNIT)
    kinds = states.schema["top"].dataType.elementType
    left = F.filter(F.coalesce("top", F.array().cast(states.schema["top"].dataType)), lambda t: F.col("gone").isNull() | (t["uid"] != F.col("gone")))
    cut = T.head(T.strip("new"), most)
    last = F.struct(_order(asked, cut).alias("order"), F.lit(2**31 - 1).alias("pos"), F.lit(None).alias("uid"), cut.alias("text")).cast(kinds)
    every = F.when(T.is_blank("new"), left).otherwise(F.array_sort(F.concat(left, F.array(last))))
    texts = F.transform(F.slice(every, 1, k), lambda t: t["text"])
    return states.withColumn("plain_input", F.concat("input_text", F.lit(" "), F.array_join(texts, " ")))


def processed(instances: DataFrame, k: int = 10, most: int = 300) -> DataFrame:
    """The processed row: inputs from the top evidence, labels, features. The plain input has a space after the query in any case."""
    texts = F.transform("evidence_units", lambda u: u["text"])
    rows = instances.withColumn("_top", F.transform(top_evidence(F.col("input_text"), texts, k, most), lambda t: t["text"]))
    features = ["graph_features"] if "graph_features" in instances.columns else []
    return rows.select(
        "input_text", T.structured_input("input_text", F.col("_top")).alias("structured_input"), F.concat("input_text", F.lit(" "), F.array_join("_top", " ")).alias("plain_input"), "evidence_state_label", *features,
        "dataset", "example_id", F.size("_top").alias("num_evidence_selected"), F.size("evidence_units").alias("num_evidence_total"), "target_answer", "target_label",
    )


def light(instances: DataFrame, most: int = 3000) -> DataFrame:
    """The light row: all stripped texts in one, cut to `most` characters."""
    texts = F.transform(F.filter(F.transform("evidence_units", lambda u: u["text"]), lambda t: ~T.is_blank(t)), T.strip)
    features = ["graph_features"] if "graph_features" in instances.columns else []
    return instances.select("input_text", T.head(F.array_join(texts, " "), most).alias("evidence_text"), "evidence_state_label", *features, "dataset", "example_id")


def feature_vector(features: Column) -> Column:
    """The features in their fixed order, missing ones 0."""
    return F.array(*(F.coalesce(features[name].cast("double"), F.lit(0.0)) for name in FEATURES))


def question_and_evidence(rows: DataFrame) -> DataFrame:
    """rows with `passages`: of structured_input, or, where that is empty, the plain input as the only one."""
    empty = F.coalesce("structured_input", F.lit("")) == ""
    return rows.withColumn("passages", F.when(empty, F.array(F.coalesce("plain_input", F.lit("")))).otherwise(T.passages_of("structured_input")))


def evidence_text() -> Column:
    """The question and its passages on lines of their own, or, where the structured input is empty, the plain input."""
    parts = F.filter(F.transform(F.split("structured_input", r"\[SEP\]"), T.strip), lambda p: p != "")
    return F.when(F.coalesce("structured_input", F.lit("")) != "", F.array_join(parts, "\n")).otherwise(F.coalesce("plain_input", "input_text"))
