"""Variants, ingest, files, scoring, streaming: small cases and properties."""

import json

import pytest
from pyspark.sql import functions as F

from prooflake.operators import ingest, pairs, scoring, variants
from prooflake.functions import text as T
from prooflake.sources import files, fixtures
from prooflake.streaming import events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def instances(spark):
    return fixtures.instances(spark, SF).cache()


def test_variants_change_counts(spark, instances):
    base = {r.item_id: r for r in instances.select("item_id", "evidence_set", "evidence_units").collect()}
    for create, units, gold in ((variants.insufficient, -1, -1), (variants.contradicted, 1, 0), (variants.superseded, 1, 0)):
        rows = create(instances).collect()
        assert rows
        for r in rows:
            b = base[r.item_id]
            assert len(r.evidence_units) == len(b.evidence_units) + units
            assert r.evidence_set.num_gold_evidence_units == b.evidence_set.num_gold_evidence_units + gold
            assert r.evidence_set.num_gold_evidence_units == sum(u.is_gold_evidence for u in r.evidence_units)


def test_variants_need_gold(spark, instances):
    none = instances.withColumn("evidence_units", F.transform("evidence_units", lambda u: u.withField("is_gold_evidence", F.lit(False))))
    assert all(create(none).count() == 0 for create in variants.CREATORS.values())


def test_variants_ignore_partitioning(spark, instances):
    key = lambda rows: sorted((r.example_id, r.evidence_units[-1].text or "") for r in rows.collect())
    assert key(variants.superseded(instances)) == key(variants.superseded(instances.repartition(5)))


def test_wiki_lines(spark):
    pages = spark.createDataFrame([("P", "0\tOne.\n1\t two \nx\tno\n2\n3\t\n1\tlast"), ("", "0\tx"), (None, None)], "id string, lines string")
    assert sorted(map(tuple, ingest.parse_wiki_lines(pages).collect())) == [("P", 0, "One."), ("P", 1, "last")]


def test_reference_fallbacks(spark):
    sentences = spark.createDataFrame([("A_b", 0, "zero"), ("A_b", 1, ""), ("C d", 0, "c")], "page_id string, sent_id int, text string")
    wanted = [("A b", 0, "zero"), ("A_b", 0, "zero"), ("A_b", 1, None), ("C_d", 0, "c"), ("C_d", 9, None), ("none", 0, None), ("A b", None, None)]
    refs = spark.createDataFrame([(u, s) for u, s, _ in wanted], "url string, sent_id int")
    assert sorted(map(tuple, ingest.resolve_references(refs, sentences).collect()), key=str) == sorted(wanted, key=str)


def test_claims(spark):
    raw = spark.createDataFrame([(1, "SUPPORTS", "c", ["P", "P", ""], [0, 0, 1]), (2, "NOT ENOUGH INFO", "c", [None], [None]), (3, "SUPPORTS", "c", [], []), (4, "odd", "c", ["Q"], [3])], "ordinal int, label string, claim string, urls array<string>, sents array<int>")
    sentences = spark.createDataFrame([("P", 0, "text")], "page_id string, sent_id int, text string")
    rows = {r.example_id: r for r in ingest.convert_claims(raw, sentences).collect()}
    assert [len(rows[k].evidence_units) for k in ("fever_000001_sufficient", "fever_000002_insufficient", "fever_000003_sufficient", "fever_000004_insufficient")] == [1, 1, 0, 1]
    assert rows["fever_000002_insufficient"].evidence_units[0].text_status == "no_evidence"
    assert rows["fever_000004_insufficient"].evidence_units[0].text_status == "unresolved_reference"


def test_multi_hop_keeps_sentence_numbers(spark):
    row = (0, "q", "a", (["T", "T"], [2, 0, 5]), (["T"], [["s0", " ", "s2"], ["cut"]]))
    raw = spark.createDataFrame([row], "ordinal int, question string, answer string, supporting_facts struct<title: array<string>, sent_id: array<int>>, context struct<title: array<string>, sentences: array<array<string>>>")
    units = ingest.convert_multi_hop(raw).first().evidence_units
    assert [(u.sentence_index, u.is_gold_evidence) for u in units] == [(0, True), (2, True)]


def test_similar_pairs_equal_brute_force(spark, instances):
    got = {(r.item_id, r.i, r.j) for r in pairs.similar_pairs(instances, 0.05, "item_id").collect()}
    wanted, rates = set(), {}
    for r in instances.collect():
        sets = [set((u.text or "").lower().split()) for u in r.evidence_units]
        close = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) > 0.05 * len(sets[i] | sets[j])}
        wanted |= {(r.item_id, i, j) for i, j in close}
        n = sum(bool(s) for s in sets)
        rates[r.item_id] = len(close) / max(1, n * (n - 1) / 2)
    assert got == wanted and wanted
    assert {r.item_id: pytest.approx(r.duplicate_rate) for r in pairs.duplicate_rates(instances, 0.05, "item_id").collect()} == rates


def test_best_detector_and_its_curve(spark):
    from prooflake.operators import models, training

    rows = spark.range(300).selectExpr("CAST(id % 3 AS INT) AS label", "CAST(id % 3 AS DOUBLE) + rand(1) AS x", "rand(2) AS y")
    best, scores = models.best_detector(rows, rows, ["x", "y"], [1e-6, 1.0, 1.0])
    assert scores[1] == scores[2] > scores[0] and best.predict(rows.withColumn("features_", rows.x)).where("pred = label").count() > 280
    assert [tuple(r) for r in training.curve(rows, [{"epoch": k, "macro_f1": s} for k, s in enumerate(scores)]).collect()] == [(k, "macro_f1", s) for k, s in enumerate(scores)]


def test_regression_equals_plain_descent(spark):
    """Balanced multinomial regression with a penalty, against gradient descent in numpy."""
    import numpy as np

    from prooflake.operators import models

    rng = np.random.default_rng(0)
    y = np.repeat([0, 1, 2], [60, 30, 15])
    x = rng.standard_normal((105, 2)) + np.stack([y, -y], 1)
    rows = spark.createDataFrame([(int(a), float(b), float(c)) for a, (b, c) in zip(y, x, strict=True)], "label int, a double, b double")
    model = models.fit_detector(rows, ["a", "b"]).model
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    w = (105 / (3 * np.bincount(y)))[y]
    coef, bias = np.zeros((3, 2)), np.zeros(3)
    for _ in range(20_000):
        s = z @ coef.T + bias
        p = np.exp(s - s.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - np.eye(3)[y]) * w[:, None] / w.sum()
        coef, bias = coef - 0.5 * (p.T @ z + coef / 105), bias - 0.5 * p.sum(0)
    got = np.array(model.coefficientMatrix.toArray())
    assert np.allclose(got - got.mean(0), coef - coef.mean(0), atol=2e-3)


def test_each_prompt_is_scored_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def factory():
        def model(prompts):
            with open(log, "a") as f:
                f.write("".join(p + "\n" for p in prompts))
            return [p.upper() for p in prompts]

        return model

    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "p string")
    assert sorted(map(tuple, scoring.score(rows, "p", factory).collect()), key=str) == sorted([("a", "A"), ("a", "A"), ("b", "B"), (None, None)], key=str)
    assert sorted(open(log).read().split()) == ["a", "b"]


def test_file_round_trips(spark, instances, tmp_path):
    from prooflake.operators.features import with_features

    rows = with_features(instances)
    files.write_features_csv(rows, str(tmp_path / "csv"))
    back = files.read_features_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select("example_id", "dataset", "evidence_state_label", "graph_features.*").collect()))
    one = [json.loads(x) for x in instances.drop("item_id").toJSON().collect()]
    (tmp_path / "array_train.json").write_text(json.dumps(one))
    assert files.read_json_array(spark, files.find_one(spark, str(tmp_path), "array")).count() == len(one)
    with pytest.raises(FileNotFoundError):
        files.find_one(spark, str(tmp_path), "nothing")
    files.write_lookup(fixtures.document_lines(spark, SF), str(tmp_path / "lookup"), 4)
    assert files.read_lookup(spark, str(tmp_path / "lookup")).count() == fixtures.document_lines(spark, SF).count()
    (tmp_path / "w").mkdir()
    (tmp_path / "w/wiki-001.jsonl").write_text('{"id": "P", "lines": "0\\tx"}\n{broken\n')
    assert list(map(tuple, files.read_wiki_pages(spark, str(tmp_path / "w")).collect())) == [("P", 0, "x")]
    assert files.example_json(instances, 3, "item_id").count() == 1


def test_stream_counts_closed_days_like_a_batch(spark, tmp_path):
    got = events.run_available(spark, SF, str(tmp_path / "out"), str(tmp_path / "check"))
    batch = events.daily_counts(fixtures.table(spark, SF, "events"))
    assert set(map(tuple, got.collect())) <= set(map(tuple, batch.collect()))
    assert got.count() >= batch.count() - 15


def test_more_round_trips(spark, tmp_path):
    from prooflake.operators import models, sampling

    rows = spark.createDataFrame([(1, "é", None), (2, None, 0.5)], "k int, t string, x double")
    files.write_json(rows, str(tmp_path / "json"))
    lines = sorted(x for f in (tmp_path / "json").glob("*.json") for x in f.read_text().splitlines())
    assert lines == ['{"k":1,"t":"é","x":null}', '{"k":2,"t":null,"x":0.5}']
    stats = models.normalizer(spark.range(9).selectExpr("CAST(id AS DOUBLE) AS x"), ["x"])
    files.save_normalizer(stats, str(tmp_path / "n"))
    assert files.load_normalizer(spark, str(tmp_path / "n")).collect() == stats.collect()
    order = [r.id for r in sampling.shuffled(spark.range(200), "id").collect()]
    assert sorted(order) == list(range(200)) != order == [r.id for r in sampling.shuffled(spark.range(200).repartition(5), "id").collect()]
    assert order == [r.id for r in sorted(sampling.shuffled_places(spark.range(200), "id").collect(), key=lambda r: r.place)]
    assert files.example_json(rows, 1, "k").first().record == '{"k":2,"x":0.5}' and files.example_json(rows, 2, "k").count() == 0
    with pytest.raises(ValueError, match="no column label, claim"):
        files.checked(rows, "fever")
