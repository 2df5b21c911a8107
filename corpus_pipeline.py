"""The training-data pipeline: quality, near duplicates, repeated passages, source mix, tokens.

STAGES are functions (spark, docs, sf_dir) -> DataFrame; run() writes each result as Parquet in the shared folder and reads it again
as the next one's docs. All but the last return the columns of documents. Every stage passes empty tables on; further
columns, whatever their names, are carried along up to the last stage: inside a stage columns go by place, not by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prooflake.llm import byte_bpe, compress_quality, simhash, source_mix, suffix_dedup
from prooflake.llm.common import positional, stored, table

#: Near duplicates: a Jaccard similarity of 0.8 or more (simhash.SIMILAR) of distinct shingles of so many words.
NEAR_WIDTH = 5


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and more columns by place, as other names may differ from these in case only or hold dots."""
    rows, at = positional(docs)
    return rows.select(*(F.col(at[c]).alias(c) for c in ("doc_id", "text", *more)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression classifier, trained on the labelled ones of its input, scores under its threshold."""
    model = compress_quality.train(spark, _texts(docs), sf_dir)
    rows, at = positional(docs)
    scored = compress_quality.score_documents(rows, model, at["text"])
    return scored.where(F.col("quality_score") >= compress_quality.THRESHOLD).drop("quality_score").toDF(*docs.columns)


def _picked(docs: DataFrame, wanted: DataFrame, *by: str) -> DataFrame:
    """The rows of docs whose id, text and columns `by` are wanted (doc_id, text_hash, by..., n, copies), `copies` times each. Of n rows that are equal in
    those, the one whose columns come first as JSON counts, so that a rerun keeps the same."""
    rows, at = positional(docs)
    id_, text, more = at["doc_id"], at["text"], [at[c] for c in by]
    keyed = rows.withColumn("text_hash", F.xxhash64(text))
    w = wanted.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), *(F.col(c).alias(f"w_{k}") for k, c in enumerate(by)), "n", "copies")
    same = F.col(id_).cast("long").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))
    for k, c in enumerate(more):
        same = same & F.col(c).eqNullSafe(F.col(f"w_{k}"))
    joined = keyed.join(w, same)
    if not wanted.where("n > 1").isEmpty():
        others = [c for c in rows.columns if c not in (id_, text, *more)]
        first = F.min_by(F.struct(*rows.columns, "copies"), F.to_json(F.struct(F.lit(0).alias("_"), *others)))
        equal = joined.where("n > 1").groupBy(F.col(id_).alias("g_id"), F.col("text_hash").alias("g_hash"), *(F.col(c).alias(f"g_{k}") for k, c in enumerate(more)))
        joined = joined.where("n = 1").select(*rows.columns, "copies").union(equal.agg(first.alias("r")).select("r.*"))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*rows.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the row with the smallest id (nulls last), and of rows equal in id and text the first by their other columns."""
    firsts = simhash.near_copies(_texts(docs), NEAR_WIDTH).where("first")
    return _picked(docs, stored(firsts.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).withColumn("copies", F.lit(1)), "firsts"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts. Characters that a cut leaves incomplete go, as do documents with nothing left but white space."""
    rows, at = positional(docs)
    others = [c for name, c in at.items() if name not in ("doc_id", "text")]
    named = rows.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), *others, F.col(at["text"]).isNull().alias("no_text"))
    cut = suffix_dedup.deduplicate(named).withColumn("new_text", F.decode(_whole_characters(F.col("kept")), "utf-8"))
    left = cut.where((F.col("n_removed") == 0) | (F.length(F.trim(F.regexp_replace("new_text", r"\s+", " "))) > 0))
    given = {c: F.col("rest")[c] for c in others} | {at["doc_id"]: F.col("doc_id"), at["text"]: F.when(~F.col("rest")["no_text"], F.col("new_text"))}
    if "n_chars" in at:
        given[at["n_chars"]] = F.when(F.col("n_removed") == 0, given[at["n_chars"]]).otherwise(F.length("new_text").cast("long"))
    return left.select(*(given[c].cast(rows.schema[c].dataType).alias(c) for c in rows.columns)).toDF(*docs.columns)


def _whole_characters(kept: F.Column) -> F.Column:
    """The bytes without incomplete UTF-8 sequences; texts that are valid (all but a few) aren't touched."""
    return F.when(F.is_valid_utf8(kept.cast("string")), kept).otherwise(F.encode(F.replace(F.make_valid_utf8(kept.cast("string")), F.lit("\ufffd"), F.lit("")), "utf-8"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops whole documents as often as source_mix says, so that each source's words come near its target. Rows with no
    words go."""
    taken = source_mix.mix(_texts(docs, "source"))
    wanted = taken.groupBy("doc_id", "text_hash", "source").agg(F.count("*").alias("n"), F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    return _picked(docs, stored(wanted.withColumn("doc_id", F.col("doc_id").cast("long")), "wanted"), "source")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and digests of ids and of the text decoded from them."""
    coded = byte_bpe.encode_documents(_texts(docs), *byte_bpe.default_vocabulary())
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup_stage), ("mix", mix), ("tokens", tokens)]

#: Neither compressed sizes nor suffix arrays can be written in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
