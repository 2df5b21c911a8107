"""The registered queries of the evidence engine; their DuckDB twins are in plans/oracles.py. Each runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prooflake.functions import responses as R
from prooflake.functions import text as T
from prooflake.functions.vocabulary import FEATURES, STATES, STOPWORDS_EVIDENCE
from prooflake.operators import assemble, context, features, graph, ingest, metrics, models, pairs, plots, remediation, sampling, thresholds, training, unit_blocks, variants
from prooflake.plans import build
from prooflake.plans.oracles import ORACLES
from prooflake.sources import files, json_arrays
from prooflake.sources import fixtures as X
from prooflake.storage import scratch, stored
from prooflake.streaming import events as event_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _flat(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, *(F.col("graph_features")[c].alias(c) for c in FEATURES))


def _rounded(rows: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in columns})


def _labelled_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of the items with a state for each, by item modulo 4."""
    state = F.element_at(F.array(*(F.lit(s) for s in STATES)), (F.col("item_id") % 4 + 1).cast("int"))
    return _flat(X.featured(spark, d), "item_id", "dataset").withColumn("state", state)


# -- features ------------------------------------------------------------------------------------------------------------------


@query
def evidence_features(spark, d):
    return _flat(X.featured(spark, d), "item_id")


@query
def evidence_pairs_jaccard(spark, d):
    found = unit_blocks.similar_pairs(X.unit_groups(spark, d, numbered=True), features.SIMILAR)
    return found.select(F.col("key").alias("item_id"), "i", "j", F.round("similarity", 6).alias("similarity"), (F.col("similarity") > features.DUPLICATE).alias("duplicate"))


@query
def duplicate_rate_by_group(spark, d):
    return _rounded(pairs.with_rate(X.duplicate_counts(spark, d, features.DUPLICATE)), "duplicate_rate")


@query
def document_overlap_rate(spark, d):
    return X.featured(spark, d).select("item_id", "graph_features.document_overlap_rate", "graph_features.source_diversity")


@query
def query_word_overlap(spark, d):
    asked = X.answer_pairs(spark, d)
    words = lambda c: T.content(T.token_set(c), STOPWORDS_EVIDENCE)
    return asked.select("conv_id", "turn", F.round(T.query_overlap(words("prediction"), words("gold")), 4).alias("word_overlap"))


@query
def named_entity_overlap(spark, d):
    """The overlap of titles from a gazetteer: the first words, and the first two and three, of all items."""
    words = T.plain_tokens("text")
    titles = X.table(spark, d, "benchmark").select(F.explode(F.array(*(F.array_join(F.slice(words, 1, n), " ") for n in (1, 2, 3)))).alias("title"))
    return features.gazetteer_overlap(X.instances(spark, d), titles, "item_id").select("item_id", "entity_overlap")


@query
def evidence_graph_nodes(spark, d):
    return graph.nodes(X.instances(spark, d))


@query
def evidence_graph_edges(spark, d):
    return _rounded(graph.edges(X.instances(spark, d, cut=0, words=True), words=True), "similarity")


# -- assembly ------------------------------------------------------------------------------------------------------------------


@query
def topk_evidence(spark, d):
    top = assemble.top_evidence(F.col("input_text"), F.transform("evidence_units", lambda u: u["text"]))
    return X.instances(spark, d).select("item_id", F.posexplode(top).alias("k", "t")).select("item_id", (F.col("k") + 1).alias("k"), F.round("t.score", 6).alias("score"), "t.text")


@query
def structured_input(spark, d):
    return assemble.processed(X.instances(spark, d)).select("example_id", "dataset", "structured_input", "plain_input", "num_evidence_selected", "num_evidence_total", "target_answer")


@query
def light_projection(spark, d):
    return assemble.light(X.instances(spark, d)).select("example_id", "dataset", "evidence_text", "evidence_state_label")


@query
def question_and_passages(spark, d):
    rows = assemble.question_and_evidence(assemble.processed(X.instances(spark, d)))
    return rows.select("example_id", F.posexplode_outer("passages").alias("k", "passage"))


@query
def text_source_priority(spark, d):
    rows = X.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("text")).alias("structured"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("plain"), "lang")
    return rows.select("doc_id", F.md5(T.head(T.first_filled("structured", "plain", F.concat_ws(" ", "lang", "plain")), 5000)).alias("text_md5"))


@query
def text_truncations(spark, d):
    """Every cut that the reference makes, as lengths."""
    cuts = [120, 200, 256, 300, 500, 512, 1000, 2000, 3000, 5000, 10000]
    return X.table(spark, d, "documents").select("doc_id", *(F.length(T.head("text", n)).alias(f"cut_{n}") for n in cuts))


@query
def feature_vectors(spark, d):
    vector = assemble.feature_vector(F.col("graph_features"))
    return X.featured(spark, d).select("item_id", F.posexplode(vector).alias("place", "value"))


# -- ingest --------------------------------------------------------------------------------------------------------------------


def _units(instances: DataFrame) -> DataFrame:
    rows = instances.select("example_id", "evidence_state_label", "agent_action_label", "evidence_set", F.posexplode_outer("evidence_units").alias("pos", "u"))
    return rows.select(
        "example_id", "evidence_state_label", "agent_action_label", "evidence_set.condition", "evidence_set.num_evidence_units", "evidence_set.num_gold_evidence_units", "evidence_set.num_sources", "pos",
        "u.evidence_id", F.md5("u.text").alias("text_md5"), "u.doc_title", "u.source_doc_id", "u.sentence_index", "u.paragraph_index", "u.text_status", "u.is_gold_evidence", "u.support_role", "u.label_strength", "u.supervision_weight",
        "u.provenance.provenance_granularity",
    )


@query
def flatten_gold_units(spark, d):
    return _units(ingest.convert_multi_hop(X.multi_hop(spark, d)))


@query
def paragraph_units(spark, d):
    return _units(ingest.convert_paragraphs(X.paragraphs(spark, d)))


@query
def claim_reference_lookup(spark, d):
    return _units(ingest.convert_claims(X.claims(spark, d), X.document_lines(spark, d)))


@query
def wiki_line_parse(spark, d):
    return ingest.parse_wiki_lines(X.wiki_pages(spark, d)).select("page_id", "sent_id", F.md5("text").alias("text_md5"))


@query
def json_array_records(spark, d):
    """Nested records written as JSON arrays by all tasks, and read back by byte ranges."""
    path = f"{scratch(spark)}/prooflake/json-arrays-{uuid.uuid4().hex}"
    json_arrays.write(X.document_records(spark, d), path)
    back = json_arrays.read(spark, path, "doc_id long, body struct<text:string,source:string>, lines array<string>")
    return back.select("doc_id", "body.source", F.md5("body.text").alias("text_md5"), F.size("lines").alias("n_lines"), F.md5(F.get("lines", F.lit(0))).alias("first_md5"))


@query
def bucketed_reference_lookup(spark, d):
    """The claims' references against a bucketed lookup, which is written once and read in place."""
    path = f"{scratch(spark)}/prooflake/lookup-{uuid.uuid4().hex}"
    files.write_lookup(X.document_lines(spark, d), path, 16)
    lookup = files.open_lookup(spark, path)
    return _units(ingest.convert_claims(X.claims(spark, d), lookup.sentences, pages=lookup.pages))


@query
def conversion_statistics(spark, d):
    made = ingest.convert_multi_hop(X.multi_hop(spark, d)).unionByName(ingest.convert_paragraphs(X.paragraphs(spark, d)))
    n = lambda c: F.col(f"evidence_set.{c}")
    return made.groupBy("dataset").agg(
        F.count("*").alias("instances"), F.sum(n("num_evidence_units")).alias("units"), F.sum(n("num_gold_evidence_units")).alias("gold"),
        F.round(F.avg(n("num_evidence_units")), 6).alias("avg_units"), F.round(F.avg(n("num_gold_evidence_units")), 6).alias("avg_gold"),
    )


@query
def gold_membership(spark, d):
    """Which lines of a conversation are gold: the semi-join alone, as a relational plan."""
    raw = X.multi_hop(spark, d).select("ordinal", "supporting_facts", "context")
    gold = raw.select("ordinal", F.explode(F.arrays_zip("supporting_facts.title", "supporting_facts.sent_id")).alias("g")).select("ordinal", F.col("g.title").alias("title"), F.col("g.sent_id").alias("sent_id")).distinct()
    docs = raw.select("ordinal", F.explode(F.arrays_zip("context.title", "context.sentences")).alias("c")).select("ordinal", F.col("c.title").alias("title"), F.posexplode("c.sentences").alias("sent_id", "sentence"))
    hit = docs.join(gold.withColumn("gold", F.lit(True)), ["ordinal", "title", "sent_id"], "left")
    return hit.groupBy("ordinal").agg(F.count("*").alias("sentences"), F.count_if(F.coalesce("gold", F.lit(False))).alias("gold"))


# -- variants ------------------------------------------------------------------------------------------------------------------


def _variant(rows: DataFrame) -> DataFrame:
    last = F.when(F.size("evidence_units") > 0, F.element_at("evidence_units", -1))
    return rows.select(
        "example_id", "evidence_state_label", "agent_action_label", "evidence_set.condition", "evidence_set.num_evidence_units", "evidence_set.num_gold_evidence_units", "evidence_set.num_sources",
        last["evidence_id"].alias("last_id"), last["support_role"].alias("last_role"), last["provenance"]["version"].alias("last_version"),
        F.array_join(F.transform(F.filter("evidence_units", lambda u: u["provenance"]["version"] == "v1_outdated"), lambda u: u["evidence_id"]), ",").alias("outdated"),
    )


@query
def variant_insufficient(spark, d):
    return _variant(variants.insufficient(X.instances(spark, d)))


@query
def variant_contradicted(spark, d):
    rows = variants.contradicted(X.instances(spark, d))
    return _variant(rows).join(rows.select("example_id", F.md5(F.element_at("evidence_units", -1)["text"]).alias("wording_md5")), "example_id")


@query
def variant_superseded(spark, d):
    rows = variants.superseded(X.instances(spark, d))
    return _variant(rows).join(rows.select("example_id", F.md5(F.element_at("evidence_units", -1)["text"]).alias("wording_md5")), "example_id")


@query
def variant_union_counts(spark, d):
    return plots.distribution(variants.all_states(X.instances(spark, d)), ["evidence_state_label", "dataset"])


@query
def merge_split_balanced(spark, d):
    rows = build.merge_split([X.instances(spark, d)])
    return rows.select("example_id", "dataset", "evidence_state_label")


@query
def row_limit(spark, d):
    """The row limit itself: the first 100 places in source order are its feature."""
    return build.first_rows(sampling.with_places(_documents(spark, d), "doc_id"), "place", 100).select("doc_id", "place")


# -- sampling ------------------------------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", "lang", "source")


@query
def seeded_sample(spark, d):
    """The sampling operator itself: 200 rows are its feature."""
    return sampling.seeded_sample(_documents(spark, d), 200, "doc_id")


@query
def shuffled_order(spark, d):
    return sampling.shuffled_places(_documents(spark, d), "doc_id").select("doc_id", "place")


@query
def balanced_classes(spark, d):
    return sampling.balanced(_documents(spark, d), "lang", "doc_id", ["de", "en", "es", "fr"]).select("doc_id", "lang")


@query
def stratified_split(spark, d):
    return sampling.stratified_split(_documents(spark, d), ["lang", "source"], "doc_id")


@query
def validation_split(spark, d):
    return sampling.validation_split(_documents(spark, d), "doc_id")


@query
def holdout_by_dataset(spark, d):
    return sampling.held_out_by(_documents(spark, d), "lang").groupBy("held_out", "split").agg(F.count("*").alias("n"))


@query
def cross_validation_folds(spark, d):
    return sampling.folds(_documents(spark, d), "lang", "doc_id")


@query
def minimum_class_size(spark, d):
    counts = _documents(spark, d).groupBy("lang").count()
    return counts.agg(F.min("count").alias("smallest"), F.sum("count").alias("n"), F.count("*").alias("classes"))


@query
def split_statistics(spark, d):
    rows = assemble.processed(X.instances(spark, d))
    split = sampling.stratified_split(rows, ["dataset"], "example_id")
    return split.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("num_evidence_selected"), 6).alias("avg_selected"), F.round(F.avg("num_evidence_total"), 6).alias("avg_total"), F.count_if(F.coalesce("target_answer", F.lit("")) != "").alias("with_answer"))


@query
def pooled_splits(spark, d):
    rows = sampling.stratified_split(_documents(spark, d), ["lang"], "doc_id")
    pooled = rows.where("split = 'train'").unionByName(rows.where("split = 'test'"))
    return pooled.groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


# -- feature tables --------------------------------------------------------------------------------------------------------------


@query
def feature_stats(spark, d):
    return _rounded(plots.statistics(_labelled_features(spark, d), FEATURES), "mean", "std")


@query
def feature_means_by_state(spark, d):
    return _rounded(plots.state_means(_labelled_features(spark, d), "state", FEATURES), "mean", "std")


@query
def feature_zscores(spark, d):
    rows = _labelled_features(spark, d)
    train = rows.where("item_id % 5 <> 0")
    return _rounded(plots.unpivoted(models.standardized(rows, models.normalizer(train, FEATURES), FEATURES), ["item_id"], FEATURES), "value")


@query
def normalizer_vector(spark, d):
    stats = models.normalizer(_labelled_features(spark, d), FEATURES)
    return stats.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.round(f"mean_{c}", 6).alias("mean"), F.round(f"std_{c}", 6).alias("std")) for c in FEATURES))))


@query
def feature_ablation(spark, d):
    rows = X.featured(spark, d).select("item_id", assemble.feature_vector(F.col("graph_features")).alias("v"))
    each = rows.select("item_id", F.explode(F.array(*(F.struct(F.lit(k).alias("dropped"), features.ablated(F.col("v"), k).alias("v")) for k in range(len(FEATURES))))).alias("a"))
    return each.groupBy("a.dropped").agg(*(F.round(F.sum(F.col("a.v")[k]), 4).alias(c) for k, c in enumerate(FEATURES)))


@query
def feature_corr(spark, d):
    return _rounded(plots.correlations(_labelled_features(spark, d), FEATURES), "r")


@query
def feature_minmax_heatmap(spark, d):
    return _rounded(plots.scaled_means(_labelled_features(spark, d), "state", FEATURES), "scaled")


@query
def feature_boxstats(spark, d):
    return _rounded(plots.box_statistics(_labelled_features(spark, d), "state", FEATURES), "q1", "median", "q3", "low", "high")


@query
def class_distribution(spark, d):
    return plots.distribution(_labelled_features(spark, d), ["state", "dataset"])


@query
def dataset_state_pivot(spark, d):
    rows = plots.class_pivot(_labelled_features(spark, d), "dataset", "state", STATES, "avg_evidence_length")
    return _rounded(rows, *STATES)


@query
def dataset_key_features(spark, d):
    return _rounded(plots.key_feature_pivot(_labelled_features(spark, d), "dataset", "state", STATES), *STATES)


@query
def dataset_state_counts(spark, d):
    return plots.class_pivot(_labelled_features(spark, d), "dataset", "state", STATES)


# -- metrics -------------------------------------------------------------------------------------------------------------------


@query
def majority_baseline(spark, d):
    rows = X.predictions(spark, d)
    best = metrics.majority(rows, "true", "doc_id")
    return _rounded(metrics.macro(metrics.confusion(rows.crossJoin(F.broadcast(best)), "true", "majority")), "accuracy", "macro_precision", "macro_recall", "macro_f1")


@query
def confusion_matrix(spark, d):
    return metrics.confusion(X.predictions(spark, d))


@query
def class_report(spark, d):
    return _rounded(metrics.class_report(metrics.confusion(X.predictions(spark, d))), "precision", "recall", "f1")


@query
def macro_metrics(spark, d):
    return _rounded(metrics.macro(metrics.confusion(X.predictions(spark, d))), "accuracy", "macro_precision", "macro_recall", "macro_f1")


@query
def per_dataset_metrics(spark, d):
    return _rounded(metrics.macro(metrics.confusion(X.predictions(spark, d), by=["dataset"]), ["dataset"]), "accuracy", "macro_precision", "macro_recall", "macro_f1")


@query
def action_accuracy(spark, d):
    named = X.predictions(spark, d).select(metrics.state_name("true").alias("state"), metrics.action_name("true").alias("wanted"), metrics.action_name("pred").alias("taken"))
    return named.groupBy("state", "wanted").agg(F.count("*").alias("n"), F.round(F.avg((F.col("wanted") == F.col("taken")).cast("double")), 6).alias("accuracy"))


@query
def running_accuracy(spark, d):
    rows = sampling.with_places(X.predictions(spark, d), "doc_id")
    return _rounded(metrics.running_accuracy(rows, "place", "true", "pred"), "accuracy")


@query
def running_macro_f1(spark, d):
    rows = sampling.with_places(X.predictions(spark, d), "doc_id")
    return _rounded(metrics.running_macro_f1(rows, "place", "true", "pred"), "macro_f1")


@query
def token_f1_em(spark, d):
    return X.answer_pairs(spark, d).select("conv_id", "turn", F.round(T.token_f1("prediction", "gold"), 6).alias("f1"), T.exact_match("prediction", "gold").alias("em"))


@query
def context_metrics(spark, d):
    rows = assemble.question_and_evidence(assemble.processed(X.instances(spark, d))).select("example_id", F.col("input_text").alias("question"), "passages", F.element_at(F.split("input_text", " "), 1).alias("gold"))
    return _rounded(context.context_metrics(rows).select("example_id", *context.METRICS), *context.METRICS)


# -- similarity baselines ---------------------------------------------------------------------------------------------------------


@query
def embedding_cosine(spark, d):
    return X.vector_pairs(spark, d).select("pair_id", F.round("score", 6).alias("score"))


@query
def binary_threshold_sweep(spark, d):
    return _rounded(thresholds.binary_sweep(X.vector_pairs(spark, d)), "macro_f1")


@query
def quartile_multithreshold(spark, d):
    return metrics.confusion(thresholds.by_quartile(X.vector_pairs(spark, d)))


@query
def threshold_strategy(spark, d):
    return _rounded(thresholds.strategy(X.vector_pairs(spark, d)), "binary_f1", "quartile_f1")


@query
def similarity_stats(spark, d):
    return _rounded(thresholds.score_statistics(X.vector_pairs(spark, d), "true"), "mean", "std", "median")


# -- model responses --------------------------------------------------------------------------------------------------------------


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "conversations").select("conv_id", "turn", "text")


@query
def nli_label_map(spark, d):
    return _turns(spark, d).select("conv_id", "turn", R.entailment_state(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))).alias("state"))


@query
def nli_argmax(spark, d):
    """The largest of every third component stand for the three logits of a model."""
    third = lambda k: F.array_max(F.filter("embedding", lambda v, i: i % 3 == k))
    logits = F.array(*map(third, range(3)))
    return X.table(spark, d, "embeddings").select("vec_id", R.argmax_state(logits).cast("int").alias("state"))


@query
def passage_prompts(spark, d):
    rows = assemble.question_and_evidence(assemble.processed(X.instances(spark, d)))
    each = rows.select("example_id", "input_text", F.posexplode(R.rated_passages(F.col("passages"))).alias("k", "passage"))
    return each.select("example_id", "k", F.md5(R.passage_prompt("input_text", "passage")).alias("prompt_md5"))


@query
def generation_prompts(spark, d):
    rows = assemble.question_and_evidence(assemble.processed(X.instances(spark, d)))
    first = F.coalesce(F.get("passages", F.lit(0)), F.lit(""))
    return rows.select("example_id", F.md5(R.generation_prompt("dataset", first, ("ds0",))).alias("prompt_md5"))


@query
def llm_label_parse(spark, d):
    return _turns(spark, d).select("conv_id", "turn", R.parse_state(X.canned("state", F.col("conv_id") + F.col("turn"))).alias("state"))


@query
def rating_vote(spark, d):
    ratings = _turns(spark, d).groupBy("conv_id").agg(F.collect_list(X.canned("rating", F.col("conv_id") * 3 + F.col("turn"))).alias("ratings"))
    return ratings.select("conv_id", R.rating_vote("ratings").alias("state"))


@query
def critic_parse(spark, d):
    return _turns(spark, d).select("conv_id", "turn", R.critic_state(X.canned("critic", F.col("conv_id") + F.col("turn"))).alias("state"))


@query
def answer_cleanup(spark, d):
    return _turns(spark, d).select("conv_id", "turn", R.clean_answer(X.canned("answer", F.col("conv_id") + F.col("turn"))).alias("answer"))


@query
def prompt_texts(spark, d):
    rows = assemble.question_and_evidence(assemble.processed(X.instances(spark, d)))
    first = F.coalesce(F.get("passages", F.lit(0)), F.lit(""))
    kinds = {"state": R.state_prompt("structured_input"), "passage": R.passage_prompt("input_text", first), "critic": R.critic_prompt("input_text", F.col("passages")), "answer": R.answer_prompt(first), "verdict": R.verdict_prompt(first)}
    return rows.select("example_id", *(F.md5(c).alias(f"{k}_md5") for k, c in kinds.items()))


# -- remediation ---------------------------------------------------------------------------------------------------------------


@query
def question_groups(spark, d):
    groups = remediation.question_groups(X.state_variants(spark, d), "question", fields=["evidence"])
    return groups.select("question", F.col("sufficient.ordinal").alias("ordinal"), F.md5("sufficient.evidence").alias("evidence_md5"), "n_variants", "n_states", "complete")


def _remediated(spark: SparkSession, d: str) -> DataFrame:
    rows = remediation.evaluation_rows(X.state_variants(spark, d), "question", "state", "ordinal", "evidence")
    guess = F.element_at(F.array(*(F.lit(s) for s in STATES)), (F.pmod(F.col("ordinal"), F.lit(4)) + 1).cast("int"))
    rows = rows.withColumn("predicted", guess).withColumn("detector_correct", F.col("predicted") == F.col("state"))
    # the model's stand-in answers with the evidence itself
    taken = lambda c: remediation.swapped("evidence", "sufficient_evidence", F.col(c) == "sufficient")
    return rows.withColumns({"gold": F.col("sufficient_evidence"), "naive_answer": F.col("evidence"), "guided_answer": taken("predicted"), "oracle_answer": taken("state")})


@query
def remediation_swap(spark, d):
    return _remediated(spark, d).select("question", "ordinal", "state", "predicted", "detector_correct", "gold", "naive_answer", "guided_answer", "oracle_answer")


@query
def end_to_end_details(spark, d):
    rows = remediation.scored_conditions(_remediated(spark, d))
    return _rounded(rows.select("question", "ordinal", "f1_naive", "f1_guided", "f1_oracle", "em_naive", "em_guided", "em_oracle"), "f1_naive", "f1_guided", "f1_oracle")


@query
def end_to_end_summary(spark, d):
    rows = remediation.summary(remediation.scored_conditions(_remediated(spark, d)), ["state", "dataset"])
    return _rounded(rows, "detector_accuracy", "f1_naive", "f1_guided", "f1_oracle", "em_naive", "em_guided", "em_oracle", "improvement", "oracle_gap", "recovery")


# -- functions -----------------------------------------------------------------------------------------------------------------


@query
def normalized_answers(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.md5(T.normalize_answer("text")).alias("answer_md5"), F.size(T.plain_tokens("text")).alias("plain_tokens"), F.size(T.token_set("text")).alias("distinct_tokens"))


@query
def title_slugs(spark, d):
    title = F.concat(F.col("p_name"), F.lit(" o'x "), F.col("p_brand"))
    return X.table(spark, d, "part").select("p_partkey", T.title_slug(title).alias("slug"), T.title_slug(title, keep_quotes=True).alias("quoted"), T.numbered("part", F.col("p_partkey") * 997).alias("name"), T.renamed_example(F.concat(F.lit("x_"), F.when(F.col("p_partkey") % 3 == 0, "gold_full").when(F.col("p_partkey") % 3 == 1, "sufficient").otherwise("y")), "superseded").alias("variant"))


@query
def daily_event_counts(spark, d):
    return event_stream.daily_counts(X.table(spark, d, "events"))


# -- models (fits have no SQL twin; their rows, splits and weights do) ---------------------------------------------------------------


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Instances of all four states: the sufficient ones and their variants."""
    return variants.all_states(X.instances(spark, d))


def _detector_rows(spark: SparkSession, d: str) -> DataFrame:
    """(example_id, dataset, label, the eight features, split), stored once for several fits."""
    found = build.flat_features(X.states_featured(spark, d)).select("example_id", "dataset", "label", *FEATURES)
    rows = stored(found, "detector-features")  # the split takes its rows several times
    return stored(sampling.stratified_split(rows, ["label", "dataset"], "example_id"), "detector-rows")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("split = 'train'"), rows.where("split = 'test'")


@query
def detector_split(spark, d):
    """The rows that the detectors are fitted on and judge, and the weights that balance the training classes."""
    label = F.array_position(F.array(*(F.lit(s) for s in STATES)), F.col("evidence_state_label")) - 1
    rows = _states(spark, d).select("example_id", "dataset", label.cast("int").alias("label"))
    train, test = _split(stored(sampling.stratified_split(rows, ["label", "dataset"], "example_id"), "detector-split"))
    return models.balanced_weights(train).withColumn("weight", F.round("weight", 6)).unionByName(test.withColumn("weight", F.lit(None).cast("double")))


@query
def features_lr(spark, d):
    """Regression on the eight features of instances in four states."""
    train, test = _split(_detector_rows(spark, d))
    return metrics.macro(metrics.confusion(models.features_regression(train, test, FEATURES), "label"))


@query
def loaded_detector_confusion(spark, d):
    """The same detector, saved, loaded and applied."""
    train, test = _split(_detector_rows(spark, d))
    detector = models.saved_and_loaded(models.fit_detector(train, FEATURES))
    return metrics.confusion(detector.predict(test), "label")


@query
def context_lr_cv(spark, d):
    """Cross-validated regression on the five context metrics of instances in four states."""
    rows = assemble.question_and_evidence(assemble.processed(_states(spark, d)))
    label = F.array_position(F.array(*(F.lit(s) for s in STATES)), F.col("evidence_state_label")) - 1
    rows = rows.select("example_id", F.col("input_text").alias("question"), "passages", F.coalesce("target_answer", F.lit("")).alias("gold"), label.cast("int").alias("label"))
    measured = stored(context.context_metrics(rows).select("example_id", "label", *context.METRICS), "context-metrics")
    return models.cross_validated(stored(sampling.folds(measured, "label", "example_id"), "context-folds"), context.METRICS)


@query
def leave_one_dataset_out(spark, d):
    return models.leave_one_out(_detector_rows(spark, d), "dataset", FEATURES)


def _fused_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = build.flat_features(X.states_featured(spark, d, texts=True))
    rows = stored(found.select("example_id", "dataset", "label", "plain_input", *FEATURES), "fused-features")
    return _split(stored(sampling.stratified_split(rows, ["label", "dataset"], "example_id"), "fused-detector-rows"))


@query
def fused_detector(spark, d):
    """A network over the terms of the evidence and the eight features, judged on held-out instances."""
    train, test = _fused_rows(spark, d)
    return build.evaluate(build.fused_detector, train, test)[0]


@query
def training_curve(spark, d):
    """Loss and scores of each epoch of the fused detector's training."""
    train, _ = _fused_rows(spark, d)
    _, _, history = training.fit_fused(train, "plain_input", "example_id", FEATURES, len(STATES))
    return _rounded(training.curve(train, history), "value")


@query
def majority_detector(spark, d):
    train, test = _split(_detector_rows(spark, d))
    return build.evaluate(build.majority, train, test)[0]


#: Terms of the TF-IDF vocabulary, as in the evaluated detector.
TERMS = 50_000


@query
def tfidf_lr(spark, d):
    """On documents and their two-class quality label, as the given tables have far more of these than of evidence sets."""
    docs = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    rows = stored(docs.select("doc_id", "text", F.col("quality").alias("label")), "labelled-texts")
    judged = build.tfidf_detector(rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0"), "text", "doc_id", TERMS)
    return metrics.macro(metrics.confusion(judged, "label"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if name in QUERIES}
