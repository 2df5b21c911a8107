"""The whole build over exported splits in the raw schemas."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from prooflake.functions.vocabulary import STATES
from prooflake.operators.metrics import confusion
from prooflake.operators import models, scoring
from prooflake.plans import build, stages
from prooflake.sources import files, fixtures, schemas

SF = "/root/testdata/sf0.001"


def test_build(spark, tmp_path):
    hop = fixtures.multi_hop(spark, SF).drop("ordinal").withColumn("id", F.md5("question")).select("id", "question", F.lit("x").alias("answer"), F.lit("t").alias("type"), F.lit("l").alias("level"), "supporting_facts", "context")
    para = fixtures.paragraphs(spark, SF).drop("ordinal").withColumn("id", F.md5("question"))
    claims = fixtures.claims(spark, SF).select(F.col("ordinal").cast("string").alias("id"), "label", "claim", F.element_at("urls", 1).alias("evidence_wiki_url"), F.element_at("sents", 1).alias("evidence_sentence_id"))
    for name, rows in (("hotpotqa", hop), ("musique", para), ("fever", claims)):
        for split in ("train", "validation"):
            rows.write.parquet(str(tmp_path / name / split))
    files.write_lookup(fixtures.document_lines(spark, SF), str(tmp_path / "wiki"), 4)
    out = str(tmp_path / "out")
    build.build(spark, {n: str(tmp_path / n) for n in ("hotpotqa", "musique", "fever")}, out, str(tmp_path / "wiki"), most=60)
    done = spark.read.parquet(f"{out}/processed/train")
    counts = {r.evidence_state_label: r["count"] for r in done.groupBy("evidence_state_label").count().collect()}
    assert set(counts) == set(STATES) and len(set(counts.values())) == 1
    assert done.select("example_id").distinct().count() == done.count()
    assert files.read_features_csv(spark, f"{out}/features/train").count() == done.count()
    assert spark.read.parquet(f"{out}/instances/train/fever").drop("dataset").columns == [c for c in spark.createDataFrame([], schemas.INSTANCE).columns if c != "dataset"]
    some = build.load_instances(spark, out, "train", ["fever", "musique"], 5)
    assert [r.count() for r in some] == [5, 5] and all(x.evidence_state_label == "sufficient" for r in some for x in r.collect())
    nodes, edges = (spark.read.parquet(f"{out}/graph/train/{t}") for t in ("nodes", "edges"))
    ends = edges.select("example_id", F.col("src").alias("node")).union(edges.select("example_id", "dst")).distinct()
    assert edges.count() and ends.join(nodes, ["example_id", "node"], "left_anti").count() == 0
    rows = build.flat_features(done)
    test = rows.where("split = 'test'")

    def answering(reply):
        return lambda: lambda prompts: [reply] * len(prompts)

    similar = lambda train, test: build.embedding_similarity("avg_evidence_length")(train, test)
    kinds = {k: build.DETECTORS[k] for k in ("majority", "tfidf_and_features", "features_only", "without_duplicate_rate", "context_metrics")}
    kinds |= {"zero_shot": build.zero_shot(answering("Superseded.")), "critic": build.critic(answering("RELEVANT: NO")), "retrieval": build.retrieval_evaluator(answering("ambiguous")), "embedding": similar}
    kinds["entailment"] = build.entailment(lambda: lambda pairs: [[2.0, -1.0, 1.0]] * len(pairs))
    assert build.experiments(spark, out, kinds) == [*kinds, "leave-one-out", "detector"]
    scores = {(r.detector, r.dataset): r for r in spark.read.json(f"{out}/results/metrics").collect()}
    assert {d for d, _ in scores} == set(kinds) and all(scores[d, "all"].n == test.count() for d in kinds)
    said = {(r.detector, r.pred) for r in spark.read.json(f"{out}/results/confusion").collect() if r.detector in ("zero_shot", "critic", "entailment")}
    assert said == {("zero_shot", 3), ("critic", 1), ("entailment", 2)}
    # what was saved judges as what was fitted
    loaded = models.Detector.load(spark, f"{out}/detector")
    again = confusion(loaded.predict(test), "label").agg(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).first()[0]
    assert again == pytest.approx(scores["features_only", "all"].accuracy)
    _rest_of_the_build(spark, out, test, loaded, {n: str(tmp_path / n) for n in ("hotpotqa", "musique", "fever")}, str(tmp_path / "wiki"), kinds, tmp_path)


def _rest_of_the_build(spark, out, test, detector, sources, wiki, kinds, tmp_path):
    calls = tmp_path / "calls"

    def counting():
        def model(prompts):
            with calls.open("a") as f:
                f.write("".join(f"{len(p)}\n" for p in prompts))
            return [f"Answer: {p.splitlines()[-3]}\nmore" for p in prompts]  # the last line of the evidence

        return model

    summary = {(r.level, r.value): r for r in build.end_to_end(spark, out, counting, "canned", claims=()).collect()}
    asked = calls.read_text().count("\n")
    # by hand
    rows = [r.asDict() for r in detector.predict(test).collect()]
    questions = {}
    for r in sorted(rows, key=lambda r: r["example_id"]):
        questions.setdefault(r["input_text"], []).append(r)
    evidence = lambda r: "\n".join(p.strip() for p in r["structured_input"].split("[SEP]") if p.strip())
    answer = lambda r: evidence(r).splitlines()[-1].strip()
    n = right = exact = guided = 0
    prompts = set()
    for variants in questions.values():
        sufficient = [v for v in variants if v["evidence_state_label"] == "sufficient"]
        if not sufficient:
            continue
        best = sufficient[-1]
        for v in [best, *(v for v in variants if v["evidence_state_label"] != "sufficient")]:
            n += 1
            prompts |= {evidence(v), evidence(best)}
            right += STATES[v["pred"]] == v["evidence_state_label"]
            gold = best["target_answer"] or best["target_label"] or answer(best)
            exact += answer(v) == gold
            guided += (answer(v) if v["pred"] == 0 else answer(best)) == gold
    assert n and summary["overall", "all"].n == n and asked == len(prompts)
    assert summary["overall", "all"].detector_accuracy == pytest.approx(right / n)
    assert summary["overall", "all"].em_naive >= exact / n - 1e-9 and summary["overall", "all"].em_guided >= guided / n - 1e-9  # normalised answers agree more often
    # a second run asks nothing, and finished stages don't run again
    again = {(r.level, r.value): r for r in build.end_to_end(spark, out, counting, "canned", claims=()).collect()}
    assert again == summary and calls.read_text().count("\n") == asked
    assert spark.read.json(f"{out}/results/end_to_end/details").count() == n
    with pytest.raises(FileNotFoundError, match="run the experiments"):
        build.end_to_end(spark, f"{out}/graph", counting, "canned")
    assert build.figures(spark, out) == ["train", "validation"] and build.figures(spark, out) == []
    assert spark.read.json(f"{out}/figures/train/dataset_states").count() == 3 and spark.read.json(f"{out}/figures/train/feature_means").count() == 32
    assert build.build(spark, sources, out, wiki, most=60) == [] and build.experiments(spark, out, kinds) == []
    # lost output of one stage: it runs again, and what reads it
    next((tmp_path / "out" / "instances" / "train" / "musique").glob("*.parquet")).unlink()
    assert build.build(spark, sources, out, wiki, most=60) == ["convert-train-musique", "describe-train"]


def test_stage_dies_and_is_redone(spark, tmp_path):
    out, source, made = str(tmp_path), str(tmp_path / "in"), str(tmp_path / "made")
    spark.range(3).write.parquet(source)

    def whole():
        spark.read.parquet(source).write.mode("overwrite").parquet(made)

    def dies():
        spark.range(1).write.mode("overwrite").parquet(made)
        raise RuntimeError("lost")

    run = lambda make, **s: stages.once(spark, out, "x", make, [source], [made], **s)
    assert run(whole, k=1) and not run(dies, k=1)
    with pytest.raises(RuntimeError):
        run(dies, k=2)
    # the half-written output isn't taken for that of the first settings
    assert run(whole, k=1) and spark.read.parquet(made).count() == 3 and not run(dies, k=1)
    spark.range(5).write.mode("append").parquet(source)
    assert run(whole, k=1) and spark.read.parquet(made).count() == 8


def test_responses_are_resumed(spark, tmp_path):
    folder, calls = str(tmp_path / "responses"), tmp_path / "calls"

    def factory(breaks=False):
        def model(prompts):
            if breaks and "p7" in prompts:
                raise RuntimeError("lost")
            with calls.open("a") as f:
                f.write("".join(f"{p}\n" for p in prompts))
            return [p.upper() for p in prompts]

        return lambda: model

    rows = spark.createDataFrame([(i, f"p{i % 40}") for i in range(100)] + [(100, None), (101, "")], "id int, p string")
    with pytest.raises(Exception, match="lost"):
        scoring.respond(rows, "p", factory(True), folder, "m")
    kept = scoring.responses(spark, folder, "m").count()
    before = len(calls.read_text().splitlines())
    got = {r.id: r.response for r in scoring.respond(rows, "p", factory(), folder, "m").collect()}
    assert got == {i: f"P{i % 40}" for i in range(100)} | {100: None, 101: ""}
    assert 0 < kept < 41 and len(calls.read_text().splitlines()) - before == 41 - kept
    scoring.respond(rows, "p", factory(True), folder, "m").collect()
    assert scoring.responses(spark, folder, "other").count() == 0
    with pytest.raises(Exception, match="0 responses to"):
        scoring.respond(rows, "p", lambda: lambda prompts: [], folder, "short")


def test_numbers_of_pairs(spark):
    rows = spark.createDataFrame([(0, "a", "b"), (1, "a", "b"), (2, None, "bb"), (3, "", "bb"), (4, "aaa", None)], "id int, x string, y string")
    model = lambda: lambda pairs: [[len(a), len(b), 0.5] for a, b in pairs]
    got = {r.id: list(r.logits) for r in scoring.score_pairs(rows, "x", "y", model).collect()}
    assert got == {0: [1, 1, 0.5], 1: [1, 1, 0.5], 2: [0, 2, 0.5], 3: [0, 2, 0.5], 4: [3, 0, 0.5]}
    with pytest.raises(Exception, match="numbers of shape"):
        scoring.score_pairs(rows, "x", "y", lambda: lambda pairs: [[1.0]] * len(pairs)).collect()


def test_ordinals_follow_the_files(spark, tmp_path):
    for k, part in enumerate(("b", "a", "c")):
        spark.createDataFrame([(f"{part}{i}",) for i in range(3 + k)], "id string").coalesce(1).write.parquet(str(tmp_path / f"raw_{part}"))
        (tmp_path / "x" / "train").mkdir(parents=True, exist_ok=True)
        next((tmp_path / f"raw_{part}").glob("*.parquet")).rename(tmp_path / "x" / "train" / f"{part}.parquet")
    rows = sorted((r.ordinal, r.id) for r in files.read_split(spark, str(tmp_path / "x"), "train").collect())
    assert rows == list(enumerate([f"a{i}" for i in range(4)] + [f"b{i}" for i in range(3)] + [f"c{i}" for i in range(5)]))
    with pytest.raises(FileNotFoundError, match="no split test"):
        files.read_split(spark, str(tmp_path / "x"), "test")
    with pytest.raises(FileNotFoundError):
        files.read_sentences(spark, dump=str(tmp_path / "none"))


def test_older_records(spark):
    rows = spark.createDataFrame([((["a", "b"], [1, 2]),)], "s struct<title: array<string>, sent_id: array<int>>")
    assert [tuple(x) for x in files.lists_as_records(rows, "s").first().s] == [("a", 1), ("b", 2)]
    assert files.lists_as_records(files.lists_as_records(rows, "s"), "s").columns == ["s"]


def test_dry_run():
    said = subprocess.run([sys.executable, "-m", "prooflake.plans.build", "--source", "fever=/x", "--out", "/y", "--dry-run", "--smoke"], capture_output=True, text=True, timeout=120, check=True).stdout
    assert "/x/{train,validation} -> /y/instances -> /y/graph, /y/processed (fever, 200 rows)" in said and "/y/processed -> /y/results (majority, tfidf," in said
