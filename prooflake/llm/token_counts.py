"""Token counts of documents in flat token files: a vectorised separator scan, stitched across blocks by a prefix scan.

A shard is one stream of little-endian unsigned 16-bit ids in which every document ends with a separator id; it has no index
of where documents begin. It is read in blocks that end anywhere. Within a block numpy finds the separators; over the blocks
of a shard running sums and maxima of (separators, position of the last separator) give each block the ordinal and the begin
of the document that is open where it starts. The scan has two levels (groups of GROUP_BLOCKS blocks, then the groups), so a
shard with very many blocks is not one task's work.

Rows: null and empty texts are documents of no tokens. Documents with equal or null ids are each counted. A stream that ends
without a separator ends with a document all the same. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prooflake.llm.byte_bpe import CHUNK_BYTES, ByteBpe, default_vocabulary
from prooflake.llm.common import runs, stored, table, texts_of

BLOCK_TOKENS = 1 << 16
GROUP_BLOCKS = 256
#: The id after the last of the vocabulary, which is free.
SEPARATOR = 50256


def write_shards(docs: DataFrame, pieces: list[bytes], pattern: str, separator: int = SEPARATOR, name: str = "token-shards") -> DataFrame:
    """A stored table (shard, block, tokens, ids): each task's documents as one stream in blocks. Rows without tokens are the
    manifest: the document ids in stream order, in pieces numbered by block."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    if not len(pieces) <= separator < 1 << 16:
        raise ValueError("the separator must be a free 16-bit id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, shard = ByteBpe(shared.value, pattern), TaskContext.get().partitionId()
        end = np.array([separator], "<u2").tobytes()
        size, block, piece, rest = 2 * BLOCK_TOKENS, 0, 0, b""

        def rows(blocks: list[int], tokens: list[bytes | None], ids: list[list | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()), pa.array(tokens, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["shard", "block", "tokens", "ids"])

        for batch in runs(batches, CHUNK_BYTES):
            texts = [t.decode("utf-8", "replace") for t in texts_of(batch.column(1))]
            stream = rest + b"".join(x for ids in coder.encode(texts) for x in (np.frombuffer(ids, "<u4").astype("<u2").tobytes(), end))
            full = len(stream) // size
            if full:
                yield rows(list(range(block, block + full)), [stream[k * size : k * size + size] for k in range(full)], [None] * full)
            block, rest = block + full, stream[full * size :]
            yield rows([piece], [None], [batch.column(0).to_pylist()])
            piece += 1
        if rest:
            yield rows([block], [rest], [None])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "shard int, block long, tokens binary, ids array<long>"), name)


def _scanned(blocks: DataFrame, separator: int) -> DataFrame:
    """Of each block: its tokens, separators, the place of the last, the tokens before the first, and the gaps between them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(2).to_pylist():
                ids = np.frombuffer(raw, "<u2")
                at = np.flatnonzero(ids == separator)
                rows.append((len(ids), len(at), int(at[-1]) if len(at) else None, int(at[0]) if len(at) else None, (np.diff(at) - 1).tolist()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["shard", "block", "n", "ends", "last", "head", "gaps"])

    return blocks.select("shard", "block", "tokens").mapInArrow(work, "shard int, block long, n long, ends long, last long, head long, gaps array<long>")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(shard, ordinal, n_tokens) of every document from (shard, block, tokens); ordinals start at 0 in each shard."""
    grouped = _scanned(blocks, separator).withColumn("grp", F.floor(F.col("block") / GROUP_BLOCKS))
    inside = Window.partitionBy("shard", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = (
        grouped.withColumn("offset", F.coalesce(F.sum("n").over(inside), zero))
        .withColumn("before", F.coalesce(F.sum("ends").over(inside), zero))
        .withColumn("mark", F.col("offset") + F.col("last"))
        .withColumn("open", F.max("mark").over(inside))
    )
    over = Window.partitionBy("shard").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("shard", "grp").agg(F.sum("n").alias("g_n"), F.sum("ends").alias("g_ends"))
    marks = local.groupBy("shard", "grp").agg(F.max("mark").alias("g_mark"))
    heads = (
        groups.join(marks, ["shard", "grp"])
        .withColumn("g_offset", F.coalesce(F.sum("g_n").over(over), zero))
        .withColumn("g_before", F.coalesce(F.sum("g_ends").over(over), zero))
        .withColumn("g_open", F.max(F.col("g_offset") + F.col("g_mark")).over(over))
    )
    placed = local.join(heads.select("shard", "grp", "g_offset", "g_before", "g_open"), ["shard", "grp"])
    begin = F.coalesce(F.col("g_offset") + F.col("open"), F.col("g_open"), F.lit(-1).cast("long")) + 1
    closed = placed.where("ends > 0").withColumn("first", F.col("g_offset") + F.col("offset") + F.col("head") - begin)
    counts = closed.select("shard", (F.col("g_before") + F.col("before")).alias("base"), F.posexplode(F.concat(F.array("first"), "gaps")).alias("k", "n_tokens"))
    # a stream whose last id is no separator leaves one more document
    tail = heads.groupBy("shard").agg(F.sum("g_n").alias("total"), F.sum("g_ends").alias("ordinal"), F.max(F.col("g_offset") + F.col("g_mark")).alias("end"))
    tail = tail.withColumn("n_tokens", F.col("total") - F.coalesce("end", F.lit(-1)) - 1).where("n_tokens > 0")
    return counts.select("shard", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens").unionByName(tail.select("shard", "ordinal", "n_tokens"))


def manifest(shards: DataFrame) -> DataFrame:
    """(shard, ordinal, doc_id) from the manifest rows of write_shards."""
    rows = shards.where("tokens IS NULL").select("shard", "block", "ids", F.size("ids").cast("long").alias("m"))
    order = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("m").over(order), F.lit(0))).select("shard", "base", F.posexplode("ids").alias("k", "doc_id")).select("shard", (F.col("base") + F.col("k")).alias("ordinal"), "doc_id")


def count_documents(docs: DataFrame, pieces: list[bytes], pattern: str) -> DataFrame:
    """(doc_id, n_tokens) of every row; a document that the scan doesn't find, or finds without the manifest, is an error."""
    shards = write_shards(docs, pieces, pattern)
    counts = count_tokens(shards.where("tokens IS NOT NULL"))
    both = manifest(shards).withColumn("listed", F.lit(True)).join(counts, ["shard", "ordinal"], "full")
    n = F.when(F.col("listed") & F.col("n_tokens").isNotNull(), F.col("n_tokens")).otherwise(F.raise_error(F.lit("manifest and token stream differ")).cast("long"))
    return both.select("doc_id", n.alias("n_tokens"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(table(spark, sf_dir, "documents"), *default_vocabulary())
