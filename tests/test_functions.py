"""Hand-worked values of the text functions and parsers."""

import pytest
from pyspark.sql import functions as F

from prooflake.functions import responses as R
from prooflake.functions import text as T
from prooflake.operators import context, features, metrics, sampling, thresholds


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*(F.lit(x) for x in v)).cast("array<string>").alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "wanted"), [("The Eiffel Tower.", "eiffel tower"), ("a.b-c", "bc"), ("U.S.A.", "us"), ("theory of a", "theory of")])
def test_normalize_answer(spark, text, wanted):
    assert one(spark, T.normalize_answer("t"), t=text) == wanted


@pytest.mark.parametrize(("p", "g", "f1", "em"), [("the cat sat", "cat sat down", 0.8, 0), ("cat cat", "cat", 2 / 3, 0), ("", "x", 0, 0), ("the", "a", 1, 1)])
def test_token_f1(spark, p, g, f1, em):
    assert one(spark, T.token_f1("p", "g"), p=p, g=g) == pytest.approx(f1)
    assert one(spark, T.exact_match("p", "g"), p=p, g=g) == em


@pytest.mark.parametrize(("a", "b", "wanted"), [("A b c", "a B d", 0.5), ("a b c d", "a b c e", 0.6), ("a, b", "a b", 1 / 3), ("", "x", 0)])
def test_jaccard(spark, a, b, wanted):
    assert one(spark, T.jaccard(T.token_set("a"), T.token_set("b")), a=a, b=b) == pytest.approx(wanted)


def test_ids_are_padded_not_cut(spark):
    assert one(spark, T.numbered("x", F.col("n")), n=1234567) == "x_1234567"
    assert one(spark, T.numbered("x", F.col("n")), n=7) == "x_000007"


@pytest.mark.parametrize(("old", "new"), [("x_gold_full", "x_superseded"), ("x_sufficient", "x_superseded"), ("x", "x_superseded")])
def test_renamed_example(spark, old, new):
    assert one(spark, T.renamed_example("o", "superseded"), o=old) == new


def test_tokens_split_on_unicode_space(spark):
    assert one(spark, T.tokens("t"), t="A b\x1cC\t d") == ["a", "b", "c", "d"]


@pytest.mark.parametrize(("response", "state"), [("Insufficient.", 1), ("sufficient", 0), ("it contradicts", 2), ("dunno", 0)])
def test_parse_state(spark, response, state):
    assert one(spark, R.parse_state("r"), r=response) == state


@pytest.mark.parametrize(("ratings", "state"), [(["INCORRECT"], 2), (["AMBIGUOUS", "CORRECT"], 1), (["CORRECT", "CORRECT"], 0), ([], 0)])
def test_rating_vote(spark, ratings, state):
    assert one(spark, R.rating_vote("r"), r=ratings) == state


@pytest.mark.parametrize(("text", "state"), [("RELEVANT: YES\nSUPPORT: FULLY", 0), ("RELEVANT: NO\nSUPPORT: FULLY", 1), ("RELEVANT: YES\nSUPPORT: NO", 2), ("RELEVANT: YES\nSUPPORT: PARTIALLY", 1), ("", 1)])
def test_critic(spark, text, state):
    assert one(spark, R.critic_state("r"), r=text) == state


@pytest.mark.parametrize(("label", "state"), [(2, 0), (1, 1), (0, 2), (7, 1)])
def test_entailment(spark, label, state):
    assert one(spark, R.entailment_state("r"), r=label) == state


def units(spark, rows):
    """An instance frame of (query, [(text, title)])."""
    schema = "input_text string, evidence_units array<struct<text: string, doc_title: string>>"
    return spark.createDataFrame(rows, schema)


def test_features_by_hand(spark):
    rows = units(spark, [("What is the capital of France ?", [("Paris is the capital", "T1"), ("Paris is the capital city", "T1"), (" \t", "T2"), (None, "none"), ("Lyon is big", "T3")]), ("x", [])])
    filled, empty = (tuple(r.graph_features) for r in features.with_features(rows).collect())
    assert filled == (3, 0.6, 4.0, 3, 0.3333, 0.4, 0.3333, 5)
    assert empty == (0, 0, 0, 0, 0, 0, 0, 0)


def test_macro_metrics_by_hand(spark):
    rows = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 3], [0, 1, 1, 1, 2, 2], strict=True)), "true int, pred int")
    table = metrics.confusion(rows)
    assert [round(r.f1, 6) for r in metrics.class_report(table).orderBy("label").collect()] == [0.666667, 0.8, 0.666667, 0.0]
    got = metrics.macro(table).first()
    assert (round(got.accuracy, 6), round(got.macro_f1, 6)) == (0.666667, 0.533333)


def test_quartiles(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "score double")
    assert tuple(thresholds.quartiles(rows).first()) == (1.75, 3.0, 5.25)


def test_sweep_has_a_score_on_each_threshold(spark):
    """Scores that are exactly thresholds, the case that intervals could get wrong."""
    rows = spark.createDataFrame([(k / 100, k % 2) for k in range(100)], "score double, true int")
    got = {r.step: r.macro_f1 for r in thresholds.binary_sweep(rows).collect()}
    for step in range(100):
        pred = [0 if k / 100 >= step / 100 else 1 for k in range(100)]
        f1s = []
        for c in {k % 2 for k in range(100)} | set(pred):
            tp = sum(p == c == k % 2 for k, p in enumerate(pred))
            f1s.append(2 * tp / (sum(p == c for p in pred) + sum(k % 2 == c for k in range(100))))
        assert got[step] == pytest.approx(sum(f1s) / len(f1s))


@pytest.mark.parametrize(("n", "test"), [(1, 1), (4, 1), (5, 1), (11, 2)])
def test_strata_sizes(spark, n, test):
    rows = spark.range(n).withColumn("s", F.lit("x"))
    assert sampling.stratified_split(rows, ["s"], "id").where("split = 'test'").count() == test


def test_sampling_ignores_partitioning(spark):
    rows = spark.range(500).withColumn("s", F.col("id") % 3)
    split = lambda r: {(x.id, x.split) for x in sampling.stratified_split(r, ["s"], "id").collect()}
    assert split(rows) == split(rows.repartition(7).orderBy(F.desc("id")))
    assert {r.id for r in sampling.seeded_sample(rows, 50, "id").collect()} == {r.id for r in sampling.seeded_sample(rows.repartition(5), 50, "id").collect()}


def test_balanced_with_a_missing_class_is_empty(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(9)], "id long, label string")
    assert sampling.balanced(rows, "label", "id", ["a", "b"]).groupBy("label").count().orderBy("label").collect() == [("a", 4), ("b", 4)]
    assert sampling.balanced(rows, "label", "id", ["a", "b", "c"]).count() == 0


def test_places_are_ranks(spark):
    rows = spark.createDataFrame([(k * k,) for k in range(50)], "id long").repartition(5)
    assert sorted((r.id, r.place) for r in sampling.with_places(rows, "id").collect()) == [(k * k, k) for k in range(50)]


def test_context_metrics_without_passages(spark):
    rows = spark.createDataFrame([("q", [], "g"), ("red fox", ["The red fox ran far", "no"], "fox")], "question string, passages array<string>, gold string")
    none, some = context.context_metrics(rows).collect()
    assert tuple(none)[3:] == (0, 0, 0, 0, 0)
    assert tuple(some)[3:] == (0.5, 1.0, 0.5, 0.5, 1.0)


def test_bounds_take_exact_numbers(spark):
    """Equal to a full sort by rank and key, for every group, null ones too."""
    from prooflake.functions.text import hash_rank

    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 3 AS STRING) END AS s")
    got = {r.id for r in sampling.stratified_split(rows, ["s"], "id", 0.3).where("split = 'test'").collect()}
    ranked = {}
    for r in rows.withColumn("rank", hash_rank("42|split", F.col("id"))).collect():
        ranked.setdefault(r.s, []).append((r.rank, r.id))
    assert got == {i for v in ranked.values() for _, i in sorted(v)[: max(1, int(len(v) * 0.3))]}
    assert "Window" not in str(sampling.stratified_split(rows, ["s"], "id")._jdf.queryExecution().optimizedPlan()).split("Join")[0]


def test_folds_deal_each_class_round(spark):
    rows = spark.range(500).selectExpr("id * id AS id", "CAST(id % 3 AS INT) AS c").repartition(7)
    found = {}
    for r in sorted(sampling.folds(rows, "c", "id").collect()):
        found.setdefault(r.c, []).append(r.fold)
    assert all(v == [k % 5 for k in range(len(v))] for v in found.values())


def test_places_with_one_outlying_key(spark):
    rows = spark.createDataFrame([(k,) for k in [*range(200), 1 << 60]], "id long").repartition(3)
    assert sorted(r.place for r in sampling.with_places(rows, "id").collect()) == list(range(201))


@pytest.mark.parametrize(("logits", "state"), [([0.1, 0.2, 0.9], 0), ([0.5, 0.9, 0.1], 1), ([3.0, 1.0, 2.0], 2), ([1.0, 1.0, 1.0], 2)])
def test_argmax(spark, logits, state):
    assert spark.range(1).select(R.argmax_state(F.array(*(F.lit(x) for x in logits))).alias("x")).first().x == state


def test_generation_prompts(spark):
    assert "Verdict" in one(spark, R.generation_prompt("d", "e"), d="fever", e="x") and "few words" in one(spark, R.generation_prompt("d", "e"), d="hotpotqa", e="x")


def longest_titles(tokens, titles):
    """From the left, at each token the longest title that begins there; none over another."""
    found, at = set(), 0
    while at < len(tokens):
        n = max((len(t) for t in titles if tuple(tokens[at : at + len(t)]) == t), default=0)
        if n:
            found.add(" ".join(tokens[at : at + n]))
        at += max(n, 1)
    return found


def test_gazetteer_equals_brute_force(spark, monkeypatch):
    import random

    from prooflake.operators import features

    rng = random.Random(11)
    words = ["a", "b", "c", "ab", "Éa", "d"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(14)] + ["A, b!", None, "", "?!"]
    texts = [" ".join(rng.choices([*words, "x,", "-", "B."], k=rng.randint(0, 25))) for _ in range(80)]
    rows = spark.createDataFrame([(k, texts[k], [(texts[-1 - k],), (None,), (" ",), (texts[k // 2],)]) for k in range(80)] + [(80, None, []), (81, "a", None)], "k int, input_text string, evidence_units array<struct<text:string>>")
    titles = spark.createDataFrame([(n,) for n in names], "title string")
    plain = lambda t: "".join(c for c in (t or "").lower() if c.isalnum() or c in "_ ").split()
    known = {tuple(plain(n)) for n in names} - {()}
    wanted = {}
    for r in rows.collect():
        asked = longest_titles(plain(r.input_text), known)
        told = longest_titles(plain(" ".join(u.text for u in r.evidence_units or [] if (u.text or "").strip())), known)
        wanted[r.k] = round(len(asked & told) / len(asked), 4) if asked else 0.0
    for most in (1000, 3):
        monkeypatch.setattr(features, "MOST_TITLES", most)
        got = {r.k: r.entity_overlap for r in features.gazetteer_overlap(rows, titles, "k").collect()}
        assert got == wanted and len(set(wanted.values())) > 3
    assert features.gazetteer_overlap(rows, titles.where("false"), "k").where("entity_overlap > 0").count() == 0
