"""The benchmark build as one application: convert, vary, merge, describe, assemble, split; and the experiments on what it wrote.

    python -m prooflake.plans.build --source hotpotqa=/data/hotpotqa --source fever=/data/fever --wiki /data/lookup --out /data/built
        [--stage process|experiments|end_to_end|figures|all] [--only detector] [--model package.module:function] [--dry-run] [--smoke]

Each source is a folder of exported splits (Parquet). Written are canonical instances, graph tables, processed splits, features,
of the experiments the metrics and confusion tables of every detector, the answers of a language model under three conditions, and
the tables behind the figures. Finished stages are skipped (plans/stages.py).
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prooflake import storage
from prooflake.functions import responses as R
from prooflake.functions import text as T
from prooflake.functions.vocabulary import FEATURES, STATES
from prooflake.operators import assemble, context, features, graph, ingest, metrics, models, plots, remediation, sampling, scoring, thresholds, training, variants
from prooflake.plans import stages
from prooflake.sources import files

SMOKE_ROWS = 200
#: Characters of either text that a model of entailment gets.
ENTAILMENT_CHARS = 512


def first_rows(rows: DataFrame, ordinal: str, n: int | None) -> DataFrame:
    """The first n rows in source order: a filter on the ordinal, so it is pushed down and doesn't depend on partitioning."""
    return rows if n is None else rows.where(F.col(ordinal) < n)


def convert(name: str, raw: DataFrame, sentences: DataFrame | None, most: int | None = None) -> DataFrame:
    """Canonical instances of a source. raw has `ordinal`, the row's number in source order (files.read_split)."""
    rows = first_rows(files.checked(raw, name), "ordinal", most)
    if name == "fever":
        if sentences is None:
            raise ValueError("claims need a sentence lookup")
        one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast(f"array<{raw.schema[c].dataType.simpleString()}>"))
        return ingest.convert_claims(rows.withColumns({"urls": one("evidence_wiki_url"), "sents": one("evidence_sentence_id")}), sentences, name)
    return (ingest.convert_paragraphs if name == "musique" else ingest.convert_multi_hop)(rows, name)


def load_instances(spark: SparkSession, out: str, split: str, sources: list[str], most: int | None = None, seed: int = 42) -> list[DataFrame]:
    """Sufficient instances of each source as written by build, of each a seeded sample of `most` rows if given."""
    rows = [variants.sufficient_only(spark.read.parquet(f"{out}/instances/{split}/{name}")) for name in sources]
    return rows if most is None else [sampling.seeded_sample(r, most, "example_id", seed) for r in rows]


def merge_split(instances: list[DataFrame], seed: int = 42, balance: bool = True) -> DataFrame:
    """All sources with their variants, classes cut to the smallest."""
    merged = None
    for rows in instances:
        states = variants.all_states(rows, seed)
        merged = states if merged is None else merged.unionByName(states)
    return sampling.balanced(merged, "evidence_state_label", "example_id", STATES, seed) if balance else merged


def split_processed(instances: DataFrame, k: int = 10, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Processed rows with features and `split`, stratified by label and dataset."""
    rows = assemble.processed(features.with_features(instances), k)
    return sampling.stratified_split(rows, ["evidence_state_label", "dataset"], "example_id", share, seed)


def build(spark: SparkSession, sources: dict[str, str], out: str, wiki: str | None = None, most: int | None = None, seed: int = 42) -> list[str]:
    """Converts the sources and writes merged, described and processed splits. Finished stages are skipped; the names of those that ran are returned."""
    ran = []
    for split in ("train", "validation"):
        for name, folder in sorted(sources.items()):
            place = f"{out}/instances/{split}/{name}"

            def converted(name: str = name, folder: str = folder, split: str = split, place: str = place) -> None:
                sentences = files.read_lookup(spark, wiki) if wiki else None
                convert(name, files.read_split(spark, folder, split), sentences, most).write.mode("overwrite").parquet(place)

            if stages.once(spark, out, f"convert-{split}-{name}", converted, [f"{folder}/{split}", *([wiki] if wiki and name == "fever" else [])], [place], most=most):
                ran.append(f"convert-{split}-{name}")

        def described(split: str = split) -> None:
            merged = storage.stored(merge_split(load_instances(spark, out, split, sorted(sources)), seed), "merged")
            graph.nodes(merged).write.mode("overwrite").parquet(f"{out}/graph/{split}/nodes")
            graph.edges(merged).write.mode("overwrite").parquet(f"{out}/graph/{split}/edges")
            done = split_processed(merged, seed=seed) if split == "train" else assemble.processed(features.with_features(merged)).withColumn("split", F.lit("validation"))
            done.write.mode("overwrite").partitionBy("split", "dataset").parquet(f"{out}/processed/{split}")
            files.write_features_csv(spark.read.parquet(f"{out}/processed/{split}"), f"{out}/features/{split}")

        made = [f"{out}/{kind}/{split}" for kind in ("graph", "processed", "features")]
        if stages.once(spark, out, f"describe-{split}", described, [f"{out}/instances/{split}/{name}" for name in sorted(sources)], made, seed=seed):
            ran.append(f"describe-{split}")
    return ran


def flat_features(rows: DataFrame) -> DataFrame:
    """Processed rows with the eight features as columns and `label`, the state's number."""
    label = F.array_position(F.array(*(F.lit(s) for s in STATES)), F.col("evidence_state_label")) - 1
    return rows.select("*", *(F.col("graph_features")[c].alias(c) for c in FEATURES)).withColumn("label", label.cast("int"))


Detector = Callable[[DataFrame, DataFrame], DataFrame]


def majority(train: DataFrame, test: DataFrame) -> DataFrame:
    best = metrics.majority(train, "label", "example_id").withColumnRenamed("majority", "pred")
    return test.crossJoin(F.broadcast(best))  # one row


def tfidf_detector(train: DataFrame, test: DataFrame, text: str = "plain_input", key: str = "example_id", terms: int = 50_000, numbers: tuple[str, ...] = ()) -> DataFrame:
    """Regression on the terms of the training texts, and on standardised number columns if any are given."""
    vocabulary = storage.stored(models.tfidf_vocabulary(train, text, terms), "vocabulary")
    stats = storage.stored(models.normalizer(train, list(numbers)), "normalizer") if numbers else None

    def vectors(rows: DataFrame) -> DataFrame:
        found = models.tfidf(rows.select(key, text, "label", *numbers), text, key, vocabulary, terms).drop(text)
        return storage.stored(models.with_numbers(found, stats, list(numbers)) if numbers else found, "vectors")

    judged = models.fit_predict(vectors(train), vectors(test)).select(F.col(key).alias("_key"), "pred")
    return test.join(judged, test[key] == judged["_key"]).drop("_key")


def fused_detector(train: DataFrame, test: DataFrame, text: str = "plain_input", key: str = "example_id", numbers: tuple[str, ...] = tuple(FEATURES), **settings) -> DataFrame:
    """A network over hashed terms and number columns, trained in mini-batches; the best epoch judges."""
    net, stats, _ = training.fit_fused(train, text, key, list(numbers), len(STATES), **settings)
    buckets = settings.get("buckets", training.BUCKETS)
    judged = training.predict(training.inputs(test, text, key, list(numbers), stats, buckets), net, buckets)
    return test.join(judged, test[key] == judged["key"]).drop("key")


def context_detector(train: DataFrame, test: DataFrame) -> DataFrame:
    """Regression on the five metrics of the passages against question and gold answer."""

    def measured(rows: DataFrame) -> DataFrame:
        asked = assemble.question_and_evidence(rows).withColumn("_gold", F.coalesce("target_answer", F.lit("")))
        return context.context_metrics(asked, "input_text", "passages", "_gold").drop("passages", "_gold")

    return models.features_regression(measured(train), measured(test), context.METRICS)


def without(dropped: str) -> Detector:
    return lambda train, test: models.features_regression(train, test, [f for f in FEATURES if f != dropped])


#: Detectors by name: functions (train, test) of flat_features rows -> test with `pred`.
DETECTORS: dict[str, Detector] = {
    "majority": majority,
    "tfidf": tfidf_detector,
    "tfidf_and_features": lambda train, test: tfidf_detector(train, test, numbers=tuple(FEATURES)),
    "fused": fused_detector,
    "context_metrics": context_detector,
    "features_only": lambda train, test: models.features_regression(train, test, FEATURES),
    **{f"without_{c}": without(c) for c in FEATURES},
}


def zero_shot(factory: scoring.Factory) -> Detector:
    """A language model names the state."""
    return lambda train, test: scoring.score(test.withColumn("_ask", R.state_prompt("structured_input")), "_ask", factory, "_said").withColumn("pred", R.parse_state("_said")).drop("_ask", "_said")


def critic(factory: scoring.Factory) -> Detector:
    """A language model says whether passages are relevant and support an answer."""

    def judge(train: DataFrame, test: DataFrame) -> DataFrame:
        asked = assemble.question_and_evidence(test).withColumn("_ask", R.critic_prompt("input_text", F.col("passages")))
        return scoring.score(asked, "_ask", factory, "_said").withColumn("pred", R.critic_state("_said")).drop("_ask", "_said", "passages")

    return judge


def entailment(factory: scoring.PairFactory) -> Detector:
    """A model of entailment gives logits (contradiction, neutral, entailment) of question and passages; the largest names the state."""

    def judge(train: DataFrame, test: DataFrame) -> DataFrame:
        asked = assemble.question_and_evidence(test)
        plain = F.coalesce("plain_input", F.lit(""))
        # without passages the plain input stands for them, less the question that it starts with
        rest = F.when(F.startswith(plain, F.col("input_text")), T.strip(F.substring(plain, F.length("input_text") + 1, F.lit(1 << 30)))).otherwise(plain)
        texts = F.when(F.coalesce("structured_input", F.lit("")) == "", rest).otherwise(F.array_join("passages", " "))
        asked = asked.withColumns({"_first": F.substring("input_text", 1, ENTAILMENT_CHARS), "_second": F.substring(texts, 1, ENTAILMENT_CHARS)})
        return scoring.score_pairs(asked, "_first", "_second", factory, "_logits").withColumn("pred", R.argmax_state("_logits").cast("int")).drop("_first", "_second", "_logits", "passages")

    return judge


def retrieval_evaluator(factory: scoring.Factory) -> Detector:
    """A language model rates the first passages one by one, and the ratings vote."""

    def judge(train: DataFrame, test: DataFrame) -> DataFrame:
        each = assemble.question_and_evidence(test).select("example_id", "input_text", F.explode(R.rated_passages(F.col("passages"))).alias("passage"))
        said = scoring.score(each.withColumn("_ask", R.passage_prompt("input_text", "passage")), "_ask", factory, "_said")
        votes = said.groupBy(F.col("example_id").alias("_id")).agg(F.collect_list("_said").alias("_said"))
        joined = test.join(votes, test["example_id"] == votes["_id"], "left")
        return joined.withColumn("pred", R.rating_vote(F.coalesce("_said", F.array().cast("array<string>")))).drop("_id", "_said")

    return judge


def embedding_similarity(score: str) -> Detector:
    """Thresholds on a column of similarities: the better of a binary one and quartiles, both tuned on the rows that they judge."""

    def judge(train: DataFrame, test: DataFrame) -> DataFrame:
        chosen = thresholds.strategy(test, score, "label").first()
        if chosen["strategy"] == "binary_threshold":
            return test.withColumn("pred", F.when(F.col(score) >= chosen["threshold"], 0).otherwise(1))
        return thresholds.by_quartile(test, score)

    return judge


def evaluate(detector: Detector, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dataset, accuracy, macro_precision, macro_recall, macro_f1, action_accuracy, n) with dataset 'all' first, and (true, pred, n)."""
    table = storage.stored(metrics.confusion(detector(train, test), "label", by=["dataset"]), "confusion")
    overall = table.groupBy("true", "pred").agg(F.sum("n").alias("n"))
    # each state has an action of its own, so actions are right where states are
    per = metrics.macro(table, ["dataset"]).unionByName(metrics.macro(overall).withColumn("dataset", F.lit("all")))
    return per.withColumn("action_accuracy", F.col("accuracy")), overall


def experiments(spark: SparkSession, out: str, detectors: dict[str, Detector] | None = None, curve: bool = False) -> list[str]:
    """Fits every detector on the processed training rows, judges the test rows, and writes metrics, confusion tables, the leave-one-out
    table, the feature detector itself and, if asked for, the curve of the fused detector's training.

    Each detector is a stage of its own, known by its name. Returned are the names of the stages that ran.
    """
    source, ran, parts = f"{out}/processed/train", [], {}
    rows = storage.stored(flat_features(spark.read.parquet(source)), "processed")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")

    def stage(name: str, tables: Callable[[], dict[str, DataFrame]]) -> str:
        place = f"{out}/results/parts/{name}"

        def written() -> None:
            for kind, table in tables().items():
                table.write.mode("overwrite").parquet(f"{place}/{kind}")

        if stages.once(spark, out, f"experiment-{name}", written, [source], [place]):
            ran.append(name)
        return place

    for name, detector in (detectors or DETECTORS).items():
        parts[name] = stage(name, lambda d=detector, n=name: dict(zip(("metrics", "confusion"), (x.withColumn("detector", F.lit(n)) for x in evaluate(d, train, test)), strict=True)))
    results = {kind: spark.read.parquet(*(f"{place}/{kind}" for place in parts.values())) for kind in ("metrics", "confusion")}
    results["leave_one_out"] = spark.read.parquet(stage("leave-one-out", lambda: {"table": models.leave_one_out(rows, "dataset", FEATURES)}) + "/table")
    if curve:
        results["training_curve"] = spark.read.parquet(stage("training-curve", lambda: {"table": training.curve(train, training.fit_fused(train, "plain_input", "example_id", FEATURES, len(STATES))[2])}) + "/table")
    files.write_results(results, f"{out}/results")
    if stages.once(spark, out, "detector", lambda: models.fit_detector(train, FEATURES).save(f"{out}/detector"), [source], [f"{out}/detector"]):
        ran.append("detector")
    return ran


def end_to_end(spark: SparkSession, out: str, factory: scoring.Factory, model: str, most: int | None = None, claims: tuple[str, ...] = ("fever",), seed: int = 42) -> DataFrame:
    """The test questions answered under three conditions by a language model, guided by the saved detector: details and their summary, which is returned.

    Of variants the one with the last example_id is a question's sufficient one; `most` takes a seeded sample of the questions. Responses are kept in
    out/responses, so a rerun asks the model only what is new, and the conditions share them.
    """
    try:
        detector = models.Detector.load(spark, f"{out}/detector")
    except AnalysisException as error:
        raise FileNotFoundError(f"no detector in {out}/detector; run the experiments first") from error
    test = flat_features(spark.read.parquet(f"{out}/processed/train").where("split = 'test'"))
    named = F.element_at(F.array(*(F.lit(s) for s in STATES)), F.col("pred") + 1)
    judged = detector.predict(test).withColumns({"predicted": named, "evidence": assemble.evidence_text(), "state": F.col("evidence_state_label")})
    kept = judged.select("input_text", "example_id", "dataset", "state", "predicted", "evidence", "target_answer", "target_label")
    rows = remediation.evaluation_rows(kept, "input_text", "state", "example_id", "evidence", ("dataset", "target_answer", "target_label"))
    if most is not None:
        rows = rows.join(sampling.seeded_sample(rows.select("input_text").distinct(), most, "input_text", seed), "input_text", "left_semi")
    rows = storage.stored(rows, "evaluation-rows")
    told = remediation.with_answers(rows, lambda r, dataset, evidence, output: scoring.generate(r, dataset, evidence, factory, f"{out}/responses", model, output, claims))
    scored = remediation.scored_conditions(told.withColumn("dataset", F.col("sufficient_dataset"))).drop("sufficient_dataset", "sufficient_evidence", "sufficient_target_answer", "sufficient_target_label", "target_answer", "target_label")
    details = storage.stored(scored, "end-to-end")
    summary = storage.stored(remediation.summary(details, ["state", "dataset"]), "end-to-end-summary")
    files.write_results({"details": details, "summary": summary}, f"{out}/results/end_to_end")
    return summary


def figures(spark: SparkSession, out: str) -> list[str]:
    """The tables behind the figures, of each processed split. Returns the splits that were written."""
    ran = []
    for split in ("train", "validation"):

        def written(split: str = split) -> None:
            rows = storage.stored(flat_features(spark.read.parquet(f"{out}/processed/{split}")), "figure-rows")
            state = "evidence_state_label"
            tables = {
                "feature_means": plots.state_means(rows, state, FEATURES), "feature_boxes": plots.box_statistics(rows, state, FEATURES), "feature_heatmap": plots.scaled_means(rows, state, FEATURES),
                "feature_correlations": plots.correlations(rows, FEATURES), "key_features": plots.key_feature_pivot(rows, "dataset", state, STATES),
                "class_counts": plots.distribution(rows, [state, "dataset"]), "dataset_states": plots.class_pivot(rows, "dataset", state, STATES),
            }
            files.write_results(tables, f"{out}/figures/{split}")

        if stages.once(spark, out, f"figures-{split}", written, [f"{out}/processed/{split}"], [f"{out}/figures/{split}"]):
            ran.append(split)
    return ran


STAGES = ["process", "experiments", "end_to_end", "figures"]


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--source", action="append", default=[], help="name=folder")
    parser.add_argument("--wiki")
    parser.add_argument("--out", required=True)
    parser.add_argument("--stage", choices=[*STAGES, "all"], default="all")
    parser.add_argument("--only", action="append", choices=sorted(DETECTORS), help="a detector to judge; may be repeated")
    parser.add_argument("--model", help="package.module:function that makes a language model; without it nothing is answered end to end")
    parser.add_argument("--questions", type=int, help="questions to answer end to end")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--smoke", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    given = parser.parse_args()
    sources = dict(x.split("=", 1) for x in given.source)
    wanted = STAGES if given.stage == "all" else [given.stage]
    if given.stage == "all" and not given.model:
        wanted = [s for s in wanted if s != "end_to_end"]
    elif "end_to_end" in wanted and not given.model:
        parser.error("end_to_end needs --model")
    detectors = {name: DETECTORS[name] for name in given.only or DETECTORS}
    if given.dry_run:
        for name, folder in sorted(sources.items()) if "process" in wanted else ():
            print(f"{folder}/{{train,validation}} -> {given.out}/instances -> {given.out}/graph, {given.out}/processed ({name}{f', {SMOKE_ROWS} rows' if given.smoke else ''})")
        if "experiments" in wanted:
            print(f"{given.out}/processed -> {given.out}/results ({', '.join(detectors)})")
        if "end_to_end" in wanted:
            print(f"{given.out}/processed, {given.out}/detector -> {given.out}/responses, {given.out}/results/end_to_end ({given.model})")
        if "figures" in wanted:
            print(f"{given.out}/processed -> {given.out}/figures")
        return
    from prooflake.session import build_session

    spark = build_session("build")
    if "process" in wanted:
        build(spark, sources, given.out, given.wiki, SMOKE_ROWS if given.smoke else None, given.seed)
    if "experiments" in wanted:
        experiments(spark, given.out, detectors, curve=given.only is None)
    if "end_to_end" in wanted:
        module, function = given.model.split(":")
        end_to_end(spark, given.out, getattr(importlib.import_module(module), function), given.model, given.questions, seed=given.seed)
    if "figures" in wanted:
        figures(spark, given.out)


if __name__ == "__main__":
    main()
