"""Raw question-answering and claim records to canonical instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prooflake.functions import text as T

def none() -> Column:
    return F.lit(None)


def evidence_unit(
    dataset: str, evidence_id: Column, text: Column, doc_title: Column, unit_type: str, gold: Column, role: Column, native_label: Column, strength: Column, weight: Column,
    status: Column | None = None, paragraph_index: Column | None = None, sentence_index: Column | None = None,
) -> Column:
    """A unit with its provenance; provenance repeats title and places, its granularity follows the unit's type."""
    paragraph = (none() if paragraph_index is None else paragraph_index).cast("int").alias("paragraph_index")
    sentence = (none() if sentence_index is None else sentence_index).cast("int").alias("sentence_index")
    missing = none().cast("string")
    provenance = F.struct(
        F.lit(dataset).alias("dataset"), F.lit("dataset_context").alias("source_type"), doc_title.alias("doc_title"), paragraph, sentence,
        missing.alias("source_url"), missing.alias("timestamp"), missing.alias("version"), F.lit("sentence" if unit_type == "sentence" else "paragraph").alias("provenance_granularity"),
    )
    return F.struct(
        evidence_id.alias("evidence_id"), text.alias("text"), doc_title.alias("doc_title"), F.concat(F.lit(dataset + "::"), doc_title).alias("source_doc_id"),
        F.lit(unit_type).alias("canonical_unit_type"), F.lit(unit_type).alias("native_unit_type"), paragraph, sentence,
        (F.lit("available") if status is None else status).alias("text_status"), gold.alias("is_gold_evidence"), role.alias("support_role"), native_label.cast("string").alias("native_label"),
        strength.alias("label_strength"), weight.cast("double").alias("supervision_weight"), provenance.alias("provenance"),
    )


def evidence_set(condition: Column, units: Column) -> Column:
    """Counts over the units: all, gold, and distinct titles (a placeholder's title counts)."""
    return F.struct(
        condition.alias("condition"), F.lit("original").alias("created_by"), F.lit("sentence").alias("canonical_granularity"), F.lit("sentence").alias("native_granularity"),
        F.size(units).alias("num_evidence_units"), F.size(F.filter(units, lambda u: u["is_gold_evidence"])).alias("num_gold_evidence_units"),
        F.size(F.array_distinct(F.transform(units, lambda u: u["doc_title"]))).alias("num_sources"),
    )


def as_instance(rows: DataFrame, dataset: str, task: str, kind: str, example_id: Column, text: Column, answer: Column, label: Column, state: Column, condition: Column, action: Column) -> DataFrame:
    """The canonical columns, from rows that have evidence_units."""
    return rows.select(
        example_id.alias("example_id"), F.lit(dataset).alias("dataset"), F.lit(task).alias("task_type"), text.alias("input_text"), F.lit(kind).alias("input_type"), answer.cast("string").alias("target_answer"),
        label.cast("string").alias("target_label"), state.alias("evidence_state_label"), evidence_set(condition, F.col("evidence_units")).alias("evidence_set"), "evidence_units", action.alias("agent_action_label"),
    )


def convert_multi_hop(raw: DataFrame, dataset: str = "hotpotqa") -> DataFrame:
    """Documents x sentences to units; raw has `ordinal`, counted before any row is dropped. Rows without a gold sentence go.

    Blank sentences are skipped but keep their number. Parallel arrays are cut to the shorter one.
    """
    facts, context = F.col("supporting_facts"), F.col("context")
    pairs = F.least(F.size(facts["title"]), F.size(facts["sent_id"]))
    gold = F.transform(F.slice(F.arrays_zip(facts["title"].alias("t"), facts["sent_id"].alias("s")), 1, pairs), lambda f: F.struct(f["t"].alias("t"), f["s"].cast("int").alias("s")))
    prefix = T.numbered(dataset, F.col("ordinal"))

    def unit(title: Column, sentence: Column, at: Column) -> Column:
        is_gold = F.array_contains(F.col("_gold"), F.struct(title.alias("t"), at.cast("int").alias("s")))
        return evidence_unit(
            dataset, F.concat(prefix, F.lit("_"), T.title_slug(title), F.lit("_sent_"), at.cast("string")), sentence, title, "sentence", is_gold,
            F.when(is_gold, "supports").otherwise("unknown"), F.when(is_gold, "supporting_fact"), F.when(is_gold, "gold_sentence").otherwise("none"), F.when(is_gold, 1.0).otherwise(0.0), sentence_index=at,
        )

    docs = F.slice(F.arrays_zip(context["title"].alias("title"), context["sentences"].alias("sentences")), 1, F.least(F.size(context["title"]), F.size(context["sentences"])))
    numbered = lambda d: F.filter(F.transform(d["sentences"], lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: ~T.is_blank(x["s"]))
    units = F.flatten(F.transform(docs, lambda d: F.transform(numbered(d), lambda x: unit(d["title"], x["s"], x["i"]))))
    rows = raw.withColumn("_gold", gold).withColumn("evidence_units", units).where(F.exists("evidence_units", lambda u: u["is_gold_evidence"]))
    return as_instance(rows, dataset, "multi_hop_qa", "question", F.concat(prefix, F.lit("_gold_full")), F.col("question"), F.col("answer"), none(), F.lit("sufficient"), F.lit("gold_full"), F.lit("answer"))


def convert_paragraphs(raw: DataFrame, dataset: str = "musique") -> DataFrame:
    """Paragraphs to units; answerable rows without a supporting paragraph go, the others are insufficient and lose their answer."""
    prefix = T.numbered(dataset, F.col("ordinal"))

    def unit(p: Column) -> Column:
        gold = F.coalesce(p["is_supporting"], F.lit(False))
        title, place = F.coalesce(p["title"], F.lit("unknown")), F.coalesce(p["idx"], F.lit(0))
        return evidence_unit(
            dataset, F.concat(prefix, F.lit("_"), T.title_slug(title), F.lit("_para_"), place.cast("string")), p["paragraph_text"], title, "paragraph", gold,
            F.when(gold, "supports").otherwise("unknown"), F.when(gold, "supporting_paragraph"), F.when(gold, "gold_paragraph").otherwise("none"), F.when(gold, 0.8).otherwise(0.0), paragraph_index=place,
        )

    yes = F.coalesce(F.col("answerable"), F.lit(True))
    rows = raw.withColumn("evidence_units", F.transform(F.filter("paragraphs", lambda p: ~T.is_blank(p["paragraph_text"])), unit))
    rows = rows.where(~yes | F.exists("evidence_units", lambda u: u["is_gold_evidence"]))
    state = F.when(yes, "sufficient").otherwise("insufficient")
    return as_instance(
        rows, dataset, "decomposed_multi_hop_qa", "question", F.concat(prefix, F.lit("_"), state), F.col("question"), F.when(yes, F.col("answer")), none(), state,
        F.when(yes, "gold_full").otherwise("unanswerable"), F.when(yes, "answer").otherwise("retrieve_more"),
    )


def claim_state(label: Column) -> Column:
    return F.when(label == "SUPPORTS", "sufficient").when(label == "REFUTES", "contradicted").otherwise("insufficient")


def resolve_references(references: DataFrame, sentences: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """references (url, sent_id, ...) with text: of the pages named url, url with underscores, url with spaces the first that exists
    decides, and its sentence is taken or none. An empty sentence counts as none.

    The page is found once for each different url, so no row needs a number. With the tables of `files.open_lookup` neither the sentences nor
    their pages (the different page_ids) are shuffled.
    """
    pages = sentences.select("page_id").distinct() if pages is None else pages
    names = [F.col("_url"), F.replace("_url", F.lit(" "), F.lit("_")), F.replace("_url", F.lit("_"), F.lit(" "))]
    urls = references.select(F.col("url").alias("_url")).where("_url IS NOT NULL").distinct()
    tried = urls.select("_url", F.posexplode(F.array(*names)).alias("_try", "page_id")).join(pages, "page_id", "left_semi")
    chosen = tried.groupBy("_url").agg(F.min_by("page_id", "_try").alias("_page"))
    found = sentences.select(F.col("page_id").alias("_p"), F.col("sent_id").alias("_s"), F.nullif("text", F.lit("")).alias("text"))
    joined = references.drop("text").join(chosen, F.col("url") == F.col("_url"), "left")
    return joined.join(found, (F.col("_page") == F.col("_p")) & (F.col("sent_id") == F.col("_s")), "left").select(*references.drop("text").columns, "text")


def convert_claims(raw: DataFrame, sentences: DataFrame, dataset: str = "fever", pages: DataFrame | None = None) -> DataFrame:
    """Claim rows (ordinal, label, claim, urls, sents: arrays of references) to instances; each different reference is one gold unit."""
    label = F.col("label")
    refs = F.transform(F.sequence(F.lit(0), F.size("urls") - 1), lambda i: F.struct(F.get("urls", i).alias("url"), F.get("sents", i).alias("sent_id")))
    refs = F.when(F.size("urls") > 0, F.array_distinct(F.filter(refs, lambda r: F.coalesce(r["url"], F.lit("")) != ""))).otherwise(F.array().cast("array<struct<url:string,sent_id:int>>"))
    wanted = raw.where(F.coalesce(label, F.lit("")) != "NOT ENOUGH INFO").select("ordinal", F.posexplode(refs).alias("at", "r")).select("ordinal", "at", "r.url", "r.sent_id")
    texts = resolve_references(wanted, sentences, pages)
    gathered = texts.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("at", "url", "sent_id", "text"))).alias("refs"))
    prefix = T.numbered(dataset, F.col("ordinal"))
    role = F.when(label == "SUPPORTS", "supports").when(label == "REFUTES", "refutes").otherwise("unknown")

    def unit(r: Column) -> Column:
        return evidence_unit(
            dataset, F.concat(prefix, F.lit("_"), T.title_slug(r["url"], keep_quotes=True), F.lit("_sent_"), F.coalesce(r["sent_id"].cast("string"), F.lit("None"))), r["text"], r["url"], "sentence", F.lit(True),
            role, label, F.lit("gold_sentence"), F.lit(1.0), F.when(r["text"].isNotNull(), "available").otherwise("unresolved_reference"), sentence_index=r["sent_id"],
        )

    nothing = evidence_unit(dataset, F.concat(prefix, F.lit("_no_evidence")), none().cast("string"), F.lit("none"), "sentence", F.lit(False), F.lit("unknown"), label, F.lit("none"), F.lit(0.0), F.lit("no_evidence"))
    some = F.transform(F.coalesce("refs", F.array().cast("array<struct<at:int,url:string,sent_id:int,text:string>>")), unit)
    rows = raw.join(gathered, "ordinal", "left").withColumn("evidence_units", F.when(label == "NOT ENOUGH INFO", F.array(nothing)).otherwise(some))
    state = claim_state(label)
    action = F.when(label == "SUPPORTS", "answer").when(label == "REFUTES", "flag_conflict").otherwise("retrieve_more")
    condition = F.when(label == "SUPPORTS", "gold_full").when(label == "REFUTES", "refuted").otherwise("no_evidence")
    return as_instance(rows, dataset, "claim_verification", "claim", F.concat(prefix, F.lit("_"), state), F.col("claim"), none(), label, state, condition, action)


def parse_wiki_lines(pages: DataFrame) -> DataFrame:
    """(page_id, sent_id, text) from id and lines ("0<TAB>text" by line). Lines without a tab, a whole number or a text are skipped;
    of equal numbers the last stays."""
    lines = pages.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("lines", F.lit("")) != "")).select(F.col("id").alias("page_id"), F.posexplode(F.split("lines", "\n")).alias("at", "line"))
    parts = lines.select("page_id", "at", F.split("line", "\t").alias("p")).where(F.size("p") >= 2)
    rows = parts.select("page_id", "at", F.expr("try_cast(p[0] AS int)").alias("sent_id"), T.strip(F.col("p")[1]).alias("text")).where((F.col("sent_id").isNotNull()) & (F.col("text") != ""))
    return rows.groupBy("page_id", "sent_id").agg(F.max_by("text", "at").alias("text"))

