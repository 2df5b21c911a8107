"""Detectors in pyspark.ml: TF-IDF and logistic regression, regression on features, cross-validation, leave one dataset out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prooflake.operators.metrics import confusion, macro
from prooflake.operators.sampling import names_of
from prooflake.storage import scratch, stored

EPSILON = 1e-8


def normalizer(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean_<c> and std_<c> (population, plus epsilon) of each column."""
    return train.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *((F.stddev_pop(c) + EPSILON).alias(f"std_{c}") for c in columns))


def standardized(rows: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as its distance from the training mean in training deviations; stats is one row, so it is broadcast."""
    out = rows.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in columns})
    return out.drop(*stats.columns)


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with weight n / (classes * n of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_k"))
    total = counts.agg(F.sum("_k").alias("_n"), F.count("*").alias("_c"))
    weights = counts.crossJoin(F.broadcast(total)).select(F.col(label).alias("_label"), (F.col("_n") / (F.col("_c") * F.col("_k"))).alias("weight"))
    return rows.join(F.broadcast(weights), F.col(label) == F.col("_label")).drop("_label")


def regression(features: str = "features", c: float = 1.0, n: int = 1) -> LogisticRegression:
    """Multinomial with an L2 penalty of strength 1 / (c * n), on features that are already scaled."""
    return LogisticRegression(featuresCol=features, labelCol="label", weightCol="weight", family="multinomial", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=100)


def ngrams(text: Column) -> Column:
    """Lower-cased words of two letters or more, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), 0)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def term_counts(text: Column) -> Column:
    """The different n-grams of a text as structs of term and n: counted inside the row, so neither rows nor repeats of them are shuffled for it."""
    from prooflake.functions.text import let

    begins = lambda s: F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    runs = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("n")))
    return let(F.array_sort(ngrams(text)), lambda s: let(begins(s), lambda at: runs(s, at)))


def tfidf_vocabulary(train: DataFrame, text: str, size: int = 50_000) -> DataFrame:
    """(term, place, idf): the most frequent terms, idf = ln((1 + n) / (1 + df)) + 1. Bounded by `size`, so it may be broadcast."""
    n = train.count()
    counts = train.select(F.inline(term_counts(F.col(text)))).groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    best = counts.orderBy(F.desc("tf"), "term").limit(size)
    from pyspark.sql import Window

    return best.select("term", (F.row_number().over(Window.orderBy(F.desc("tf"), "term")) - 1).alias("place"), (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(rows: DataFrame, text: str, key: str, vocabulary: DataFrame, size: int) -> DataFrame:
    """rows with `features`: (1 + ln tf) * idf, to unit length. Vectors are put together in Arrow batches, in the form that ml vectors have."""
    import pyarrow as pa
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as S

    counted = rows.select(F.col(key).alias("_key"), F.inline(term_counts(F.col(text))))
    # dealt by key once, as numbers; rows of equal keys are counted together
    met = counted.join(F.broadcast(vocabulary), "term").select("_key", "place", "n", "idf").repartition("_key").groupBy("_key", "place", "idf").agg(F.sum("n").alias("n"))
    weighed = met.select("_key", "place", ((1 + F.log("n")) * F.col("idf")).alias("w"))
    lists = weighed.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("pw"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    lists = lists.select("_key", F.transform("pw", lambda x: x["place"].cast("int")).alias("at"), F.transform("pw", lambda x: x["w"] / F.col("norm")).alias("w"))
    joined = rows.join(lists, rows[key] == lists["_key"], "left").drop("_key").withColumns({"at": F.coalesce("at", F.array().cast("array<int>")), "w": F.coalesce("w", F.array().cast("array<double>"))})
    schema = S.StructType([*rows.schema.fields, S.StructField("features", VectorUDT())])
    names, columns = schema.names, len(rows.columns)

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            vector = pa.StructArray.from_arrays([pa.array([0] * n, pa.int8()), pa.array([size] * n, pa.int32()), batch.column(columns), batch.column(columns + 1)], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], vector], names=names)

    return joined.select(*rows.columns, "at", "w").mapInArrow(work, schema)


def fit_predict(train: DataFrame, test: DataFrame, features: str = "features", c: float = 1.0) -> DataFrame:
    """test with `pred`, from a balanced regression on train."""
    model = regression(features, c, train.count()).fit(balanced_weights(train))
    return _judged(model, test, features)


class Detector(NamedTuple):
    """A fitted regression on feature columns with the normaliser of its training rows."""

    columns: list[str]
    stats: DataFrame
    model: LogisticRegressionModel

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with `pred`. Rows need the feature columns only; missing ones count as 0."""
        return _judged(self.model, _vectors(rows, self.stats, self.columns), "features")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        one = self.stats.select(F.lit(",".join(self.columns)).alias("columns"), *self.stats.columns)
        one.coalesce(1).write.mode("overwrite").parquet(f"{path}/normalizer")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Detector:
        stats = spark.read.parquet(f"{path}/normalizer")
        return Detector(stats.first()["columns"].split(","), stats.drop("columns"), LogisticRegressionModel.load(f"{path}/model"))


def _vectors(rows: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    vector = array_to_vector(F.array(*((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in columns)))
    return rows.crossJoin(F.broadcast(stats)).withColumn("features", vector).drop(*stats.columns)  # stats is one row


def _judged(model: LogisticRegressionModel, vectors: DataFrame, features: str) -> DataFrame:
    return model.transform(vectors).withColumn("pred", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction", features)


def with_numbers(rows: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """rows whose vector `features` is followed by the standardised columns."""
    from pyspark.ml.feature import VectorAssembler

    both = _vectors(rows.withColumnRenamed("features", "_terms"), stats, columns).withColumnRenamed("features", "_numbers")
    return VectorAssembler(inputCols=["_terms", "_numbers"], outputCol="features").transform(both).drop("_terms", "_numbers")


def fit_detector(train: DataFrame, columns: list[str], c: float = 1.0) -> Detector:
    stats = stored(normalizer(train, columns), "normalizer")
    return Detector(columns, stats, regression("features", c, train.count()).fit(balanced_weights(_vectors(train, stats, columns))))


def best_detector(train: DataFrame, validation: DataFrame, columns: list[str], strengths: list[float]) -> tuple[Detector, list[float]]:
    """The detector with the best macro-F1 on validation rows, of equal ones the first, and the score of each."""
    best, scores = None, []
    for c in strengths:
        detector = fit_detector(train, columns, c)
        scores.append(float(macro(confusion(detector.predict(validation), "label")).first()["macro_f1"] or 0.0))
        if best is None or scores[-1] > max(scores[:-1]):
            best = detector
    return best, scores


def saved_and_loaded(detector: Detector) -> Detector:
    """The detector as it comes back from the shared folder."""
    import uuid

    spark = detector.stats.sparkSession
    path = f"{scratch(spark)}/prooflake/detector-{uuid.uuid4().hex}"
    detector.save(path)
    return Detector.load(spark, path)


def features_regression(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """test with `pred` from a regression on standardised feature columns."""
    return fit_detector(train, columns).predict(test)


def cross_validated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(fold, accuracy, macro_f1): each fold's rows judged by a regression on the others, and fold -1 by one on all rows (in sample). All are fitted
    in the same passes over the rows."""
    from prooflake.operators.folds import fit_folds, judged

    found, _ = fit_folds(rows, columns)
    return macro(confusion(judged(rows, columns, found), "label", by=["fold"]), ["fold"]).select("fold", "accuracy", "macro_f1")


def leave_one_out(rows: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    """(held_out, accuracy, macro_f1, n): each dataset judged by a regression on all others. Datasets are few and known by name; their models are
    fitted in the same passes over the rows. A single dataset has no others, so it isn't judged."""
    from prooflake.operators.folds import fit_folds, judged

    names = names_of(rows, dataset)
    if len(names) < 2:
        return rows.sparkSession.createDataFrame([], "held_out string, accuracy double, macro_f1 double, n bigint")
    numbers = F.array(*(F.lit(x) for x in names))
    folded = rows.where(F.col(dataset).isNotNull()).withColumn("fold", F.array_position(numbers, F.col(dataset)).cast("int") - 1)
    found, _ = fit_folds(folded, columns)
    tables = confusion(judged(folded, columns, found), "label", by=["fold"]).where("fold >= 0")
    return macro(tables, ["fold"]).select(F.get(numbers, F.col("fold")).alias("held_out"), "accuracy", "macro_f1", "n")
