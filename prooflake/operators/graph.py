"""The evidence graph as two tables. Nodes: the input, units by id, sources by id. Edges: relates_to, attribution, text_overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prooflake.functions import text as T
from prooflake.operators import similarity
from prooflake.operators.features import SIMILAR


def nodes(instances: DataFrame) -> DataFrame:
    """(example_id, node, type, text, has_text, title), one row per node; of units with equal ids the last describes the node."""
    root = instances.select("example_id", F.lit("input").alias("node"), F.lit("input").alias("type"), T.head("input_text", 200).alias("text"), F.lit(None).cast("boolean").alias("has_text"), F.lit(None).cast("string").alias("title"))
    units = instances.select("example_id", F.posexplode("evidence_units").alias("pos", "u"))
    last = units.groupBy("example_id", F.col("u.evidence_id").alias("node")).agg(F.max_by(F.struct((F.coalesce("u.text", F.lit("")) != "").alias("has_text"), F.col("u.doc_title").alias("title")), "pos").alias("x"))
    evidence = last.select("example_id", "node", F.lit("evidence").alias("type"), F.lit(None).cast("string").alias("text"), "x.has_text", "x.title")
    first = units.groupBy("example_id", F.col("u.source_doc_id").alias("node")).agg(F.min_by("u.doc_title", "pos").alias("title"))
    sources = first.select("example_id", "node", F.lit("source").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("has_text"), "title")
    return root.unionByName(evidence).unionByName(sources)


def similar_units(instances: DataFrame, threshold: float, key: str = "example_id", words: bool = False) -> DataFrame:
    """(key, i, j, src, dst, similarity) of the pairs of an instance's units i < j with a Jaccard similarity over the threshold.
    words: as in features.with_features."""
    of = lambda name, value: F.transform("evidence_units", value).alias(name)
    units = instances.select(key, of("i", lambda u, i: i), of("id", lambda u: u["evidence_id"]), similarity.words_of("evidence_units", words).alias("t"))
    return similarity.similar_rows(units, threshold)


def edges(instances: DataFrame, words: bool = False) -> DataFrame:
    """(example_id, src, dst, relation, similarity), one row per (src, dst); of several overlaps the last pair's similarity stays."""
    unit = lambda u: F.array(*(F.struct(u["evidence_id"].alias("src"), dst.alias("dst"), F.lit(relation).alias("relation")) for dst, relation in ((F.lit("input"), "relates_to"), (u["source_doc_id"], "attribution"))))
    plain = instances.select("example_id", F.inline(F.flatten(F.transform("evidence_units", unit)))).distinct().withColumn("similarity", F.lit(None).cast("double"))
    last = similar_units(instances, SIMILAR, words=words).groupBy("example_id", "src", "dst").agg(F.max_by("similarity", F.struct("i", "j")).alias("similarity"))
    return plain.unionByName(last.select("example_id", "src", "dst", F.lit("text_overlap").alias("relation"), "similarity"))
