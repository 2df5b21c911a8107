"""Quality scores from compressed sizes: zstandard dictionaries of good and of bad text, and a calibrated difference.

A text is cut into chunks, each chunk is compressed with either dictionary, and (bytes with the bad dictionary - bytes with
the good one) / bytes of text, summed over all chunks, is turned into a probability by a logistic curve that is fitted on
labelled rows that the dictionaries of the fit haven't seen. A short text hardly lets the sizes differ, so its evidence counts for
bytes / (bytes + half) and the share of good labels for the rest; half is fitted too.

Fitting uses a bounded sample: SAMPLE_DOCS rows of each class, by seeded hash, among the learnable ones that have any text. A sampled
text is used whole up to SAMPLE_BYTES; of a longer one seeded chunks of that size in all are used, in their order. Scoring reads every
whole text. Rows: null texts score as empty ones, empty ones as the share of good labels; repeated rows get equal scores; a document
labelled more than once counts by its mean label, and not at all if that is a half; of texts that share a labelled id the smallest
is learnt. Where a class has no labelled rows, every document gets the share of good labels, smoothed. Null ids are scored too and
count as held out = false. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prooflake.llm.common import runs, stored, table, texts_of

#: Labelled documents of each class that a fit may use, and the bytes of one that it may use: at most 64 MB reach the driver.
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 256 << 10
TRAIN_CHUNK = 2048
CHUNK, LEVEL, SEED, FOLDS = 1024, 3, 42, 5
#: Sizes at which a text's own evidence may weigh as much as the share of good labels.
HALVES = (8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0)
#: Scores under this are rejected.
THRESHOLD = 0.3


class CompressionModel(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    offset: float
    half: float
    prior: float

    def probability(self, difference: float, size: int) -> float:
        trust = size / (size + self.half) if size else 0.0
        z = trust * (self.slope * difference + self.offset) + (1 - trust) * self.prior
        return 1 / (1 + math.exp(-z)) if z >= 0 else 1 - 1 / (1 + math.exp(z))


class Sizer:
    """Compresses with both dictionaries; made once in each worker."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = (self._compressor(x) for x in (good, bad))

    @staticmethod
    def _compressor(dictionary: bytes):
        import zstandard

        if not dictionary:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False).compress

    def difference(self, text: bytes) -> float:
        gap = 0
        for at in range(0, len(text), CHUNK):
            piece = text[at : at + CHUNK]
            gap += len(self.bad(piece)) - len(self.good(piece))
        return gap / max(1, len(text))


def held_out(doc_id) -> F.Column:
    """Rows whose crc32 of the id's digits leaves 0 modulo 5 are kept for judging and never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, bytes]], tuple[int, int]]:
    """At most SAMPLE_DOCS (label, text) of each class, chosen by a seeded hash of the id among the learnable rows; and how many of
    these rows there are of either class."""
    ids = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.avg(F.col("quality").cast("double")).alias("mean"))
        .where("mean <> 0.5")
        .select("id", (F.col("mean") > 0.5).cast("int").alias("label"), F.xxhash64(F.lit(SEED), "id").alias("rank"))
    )
    texts = docs.select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("bytes")).where(F.length("bytes") > 0)
    # labels are joined to what is known of the texts, so that every chosen id has one; only the chosen ids are broadcast
    known = stored(ids.join(texts.select("id"), "id", "left_semi"), "learnable")
    pieces = F.sequence(F.lit(0), F.floor((F.length("bytes") - 1) / TRAIN_CHUNK).cast("int"))
    drawn = F.slice(F.array_sort(F.transform(pieces, lambda k: F.struct(F.xxhash64(F.lit(SEED), k).alias("rank"), k.alias("k")))), 1, SAMPLE_BYTES // TRAIN_CHUNK)
    chunk = lambda k: F.substring(F.col("bytes"), k * TRAIN_CHUNK + 1, F.lit(TRAIN_CHUNK))
    some = F.array_join(F.transform(F.array_sort(F.transform(drawn, lambda d: d["k"])), lambda k: F.hex(chunk(k))), "")
    best = lambda label: known.where(F.col("label") == label).orderBy("rank", "id").limit(SAMPLE_DOCS)
    part = F.when(F.length("bytes") <= SAMPLE_BYTES, F.col("bytes")).otherwise(F.unhex(some)).alias("bytes")
    rows = texts.join(F.broadcast(best(0).union(best(1))), "id").select("id", "label", "rank", part)
    one = rows.groupBy("id").agg(F.min(F.struct("label", "rank", "bytes")).alias("row")).orderBy("row.label", "row.rank", "id")
    found = [(x.label, bytes(x.bytes)) for x in one.select("row.label", "row.bytes").collect()]
    counts = {r.label: r["count"] for r in ids.groupBy("label").count().collect()}
    return found, (counts.get(0, 0), counts.get(1, 0))


def _dictionary(texts: list[bytes], rng: np.random.Generator) -> bytes:
    import zstandard

    pieces = [t[at : at + TRAIN_CHUNK] for t in texts for at in range(0, len(t), TRAIN_CHUNK)]
    pieces = [pieces[k] for k in rng.permutation(len(pieces))]
    total = sum(map(len, pieces))
    for size in (DICTIONARY_BYTES, total // 8, total // 32):
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(size, 256)), pieces).as_bytes()
        except zstandard.ZstdError:  # too little text for that size
            continue
    return b"".join(pieces)[-DICTIONARY_BYTES:]


def fit_model(sample: list[tuple[int, bytes]], counts: tuple[int, int]) -> CompressionModel:
    """Dictionaries from the sample; the logistic curve from its FOLDS parts, each judged by dictionaries of the others. counts: labelled rows of class 0 and 1, by which the
    classes weigh, as the sample may hold them in other shares."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(sample))
    prior = math.log((counts[1] + 1) / (counts[0] + 1))
    if min(sum(label == c for label, _ in sample) for c in (0, 1)) < 2:
        return CompressionModel(b"", b"", 0.0, prior, 0.0, prior)
    # dealt within each class, so that each part's others hold both
    place = {int(k): at for c in (0, 1) for at, k in enumerate(k for k in order if sample[k][0] == c)}
    pair = lambda rows: [_dictionary([t for y, t in rows if y == c], rng) for c in (1, 0)]
    judged = []
    for fold in range(FOLDS):
        tune = [sample[k] for k in order if place[int(k)] % FOLDS == fold]
        if tune:
            sizer = Sizer(*pair([sample[k] for k in order if place[int(k)] % FOLDS != fold]))
            judged += [(sizer.difference(t), len(t), y) for y, t in tune]
    good, bad = pair(sample)
    x, size, y = (np.array(v, float) for v in zip(*judged, strict=True))
    share = counts[1] / (counts[0] + counts[1])
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    scale = float(np.std(x)) or 1.0
    best: tuple[float, CompressionModel] | None = None
    for half in HALVES:
        trust = size / (size + half)
        design, fixed = np.stack([trust * x / scale, trust], 1), (1 - trust) * prior
        beta = np.array([1.0, 0.0])
        for _ in range(100):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-np.clip(design @ beta + fixed, -30, 30)))
            hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
            step = np.linalg.solve(hessian, design.T @ (weight * (p - y)) + 1e-2 * beta)
            beta -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(design @ beta + fixed, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
        if best is None or loss < best[0]:
            best = loss, CompressionModel(good, bad, float(beta[0] / scale), float(beta[1]), half, prior)
    return best[1]


def score_documents(docs: DataFrame, model: CompressionModel, text: str = "text") -> DataFrame:
    """docs with a column quality_score (0 to 1), in one narrow pass; the model (under 1 MB) goes along by broadcast."""
    from pyspark.sql import types as T

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(model))  # a plain value: workers needn't have this package
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = CompressionModel(*shared.value)
        sizer = Sizer(held.good, held.bad)
        for batch in runs(batches, 8 << 20):
            scores = [held.probability(sizer.difference(t), len(t)) for t in texts_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[f"c{k}" for k in range(batch.num_columns + 1)])

    named = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    schema = T.StructType([*named.schema.fields, T.StructField(f"c{len(docs.columns)}", T.DoubleType())])
    return named.mapInArrow(work, schema).toDF(*docs.columns, "quality_score")


def train(spark: SparkSession, docs: DataFrame, sf_dir: str) -> CompressionModel:
    return fit_model(*labelled_sample(docs, table(spark, sf_dir, "labels")))


def op10_compress_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
