"""Pairs of similar token sets: exact, and fast enough for evidence sets of thousands of units."""

import random
import time

import numpy as np
import pytest

from prooflake.operators import features, graph, pairs, similarity


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.9])
@pytest.mark.parametrize(("frequent", "block"), [(0, 8), (3, 64), (16, 1 << 20)])
def test_similar_equals_brute_force(monkeypatch, threshold, frequent, block):
    monkeypatch.setattr(similarity, "FREQUENT_SETS", frequent)
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = np.random.default_rng(frequent)
    for n, words in ((0, 5), (1, 5), (40, 6), (50, 40), (30, 200)):
        sets = [rng.choice(words, int(rng.integers(0, words + 1)), replace=False) for _ in range(n)]
        found = similarity.similar(np.concatenate([np.zeros(0, np.int64), *sets]).astype(np.int64), np.array([len(s) for s in sets], np.int64), threshold)
        got = sorted((int(i), int(j), float(r)) for block_ in found for i, j, r in zip(*block_, strict=True))
        plain = [set(s.tolist()) for s in sets]
        ratio = {(i, j): len(plain[i] & plain[j]) / max(1, len(plain[i] | plain[j])) for j in range(n) for i in range(j)}
        assert got == sorted((i, j, r) for (i, j), r in ratio.items() if r > threshold)


def test_thousands_of_units_in_a_set(spark):
    """4,000 units of one source with some copies: eight million pairs, which took minutes one by one."""
    rng = random.Random(0)
    texts = [" ".join(f"w{int(rng.paretovariate(0.3)) % 5000}" for _ in range(80)) for _ in range(3900)]
    texts += texts[:100]
    schema = "example_id string, input_text string, evidence_units array<struct<evidence_id: string, source_doc_id: string, text: string, doc_title: string>>"
    rows = spark.createDataFrame([("e", "w1 ?", [(f"u{k}", "s", t, "T") for k, t in enumerate(texts)])], schema).cache()
    rows.count()
    begun = time.monotonic()
    found = features.with_features(rows).first().graph_features
    copies = pairs.similar_pairs(rows, 0.9).collect()
    overlaps = graph.edges(rows).where("relation = 'text_overlap'").count()
    assert time.monotonic() - begun < 40
    assert found.evidence_count == 4000 and found.document_overlap_rate == 1.0
    assert {(f"u{k}", f"u{3900 + k}") for k in range(100)} <= {(r.src, r.dst) for r in copies} and overlaps >= 100
    sets = [set(t.split()) for t in texts]
    assert all(len(sets[r.i] & sets[r.j]) > 0.9 * len(sets[r.i] | sets[r.j]) for r in copies)


def test_white_space_and_case_are_those_of_the_text_functions(spark):
    """Every white space of Unicode splits tokens, at either end as well, as T.tokens has it; blank texts and nulls count as units without text."""
    from pyspark.sql import functions as F

    from prooflake.functions import text as T

    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or chr(c).upper() != chr(c) or c in (0x200B, 0x180E, 0xFEFF))]
    texts = [f"a{c}B" for c in odd] + [f"{c}a  b{c}" for c in odd] + ["", None, " \x1c ", "same words", "Same　WORDS again same"]
    rows = spark.createDataFrame([(k, [t]) for k, t in enumerate(texts)] + [(-1, texts), (-2, []), (-3, None)], "key long, texts array<string>")
    none = F.array().cast("array<string>")
    lower = F.transform("texts", F.lower)
    asked = F.array(F.lit("same"), F.lit("nowhere"))
    got = {r.key: r for r in rows.select("key", similarity.measured(lower, asked, 0.5).alias("m")).select("key", "m.*").collect()}
    sizes = {r.key: r.n for r in rows.where("key >= 0").select("key", F.size(T.tokens(F.coalesce(F.get("texts", F.lit(0)), F.lit("")))).alias("n")).collect()}
    assert {k: (r.n, r.total, r.least) for k, r in got.items() if k >= 0} == {k: (int(n > 0), n, n) for k, n in sizes.items()}
    assert got[-1].n == sum(n > 0 for n in sizes.values()) and got[-1].total == sum(sizes.values()) and got[-1].met == 1 and got[-1].similar > 0
    assert (got[-2].n, got[-2].similar, got[-2].met) == (0, 0, 0) and got[-3].n is None
    assert rows.where("key = -1").select(similarity.measured(lower, none, 0.5)["met"]).first()[0] == 0


def test_states_from_one_pass_have_the_features_of_each(spark):
    from prooflake.operators import variants
    from prooflake.sources import fixtures

    base = fixtures.instances(spark, "/root/testdata/sf0.001").cache()
    told = lambda rows: sorted((r.example_id, r.evidence_state_label, tuple(r.graph_features)) for r in rows.select("example_id", "evidence_state_label", "graph_features").collect())
    got = told(features.all_states_with_features(base))
    assert got == told(features.with_features(variants.all_states(base))) and len({s for _, s, _ in got}) == 4


def test_words_are_told_apart_in_runs_of_texts(monkeypatch):
    """However long the runs are, sets and counts are those of all texts at once; other white space than ASCII's is looked for in each run."""
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(f"wörd{rng.randrange(40)}" for _ in range(rng.randrange(30))) for _ in range(60)] + ["", None, " ", "a b　a", "c\x1cd", "é « x » — à b", "\u0085"]
    plain = [(t or "").split() for t in texts]
    for block in (1, 100, 1 << 20):
        monkeypatch.setattr(similarity, "TEXT_BLOCK", block)
        tokens, sizes, lengths, different = similarity._set_of(pa.array(["cut", *texts])[1:])
        names, ends = different.to_pylist(), np.cumsum(sizes).tolist()
        assert lengths.tolist() == [len(t) for t in plain]
        assert [{names[t] for t in tokens[e - n : e]} for e, n in zip(ends, sizes.tolist(), strict=True)] == [set(t) for t in plain]
        assert len(set(names) - {""}) == len({w for t in plain for w in t})
    assert similarity._set_of(pa.array([], pa.string()))[1].tolist() == []


def test_texts_are_gathered_by_one_shuffle_into_even_tasks(spark):
    """Items get the units that unit_rows has, those without any too; no join, window or sort takes the texts, and small items aren't put into few tasks."""
    from pyspark.sql import functions as F

    from prooflake.sources import fixtures

    d = "/root/testdata/sf0.001"
    unit = F.struct("pos", "doc_id", "text", "doc_title", "is_gold")
    wanted = fixtures.unit_rows(spark, d).groupBy("item_id", "ds", "input_text").agg(F.array_sort(F.collect_list(F.when(F.col("doc_id").isNotNull(), unit))).alias("raw"))
    got = fixtures._gathered(spark, d)
    told = lambda rows: sorted((r.item_id, r.ds, r.input_text, tuple(map(tuple, r.raw))) for r in rows.collect())
    assert told(got) == told(wanted) and any(not r.raw for r in got.collect())
    plan = fixtures.featured(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and "REPARTITION_BY_NUM" in plan


def test_words_coded_before_a_shuffle_are_those_of_the_texts(monkeypatch):
    """Coded words give the sets, counts and words met that the texts give, short and long words, odd white space, empty texts and nulls; none is hashed."""
    import pyarrow as pa

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé深\x00") for _ in range(rng.randrange(1, 12)))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for words in [[word() for _ in range(30)]] for _ in range(50)]
    texts += ["", None, " ", "\n", "a b　a longer-words  longer-words", "c\x1cd", "é « x » — à b", "exactly7 exactl7", "x", "", "ab", "ab\x00", "a"]
    plain = [set((t or "").split()) for t in texts]
    for block in (1, 100, 1 << 20):
        monkeypatch.setattr(similarity, "TEXT_BLOCK", block)
        for own in (pa.array(["cut", *texts])[1:], similarity._coded(pa.array(texts)), pa.concat_arrays([similarity._coded(pa.array(["cut out", *texts[:20]])).slice(1), similarity._coded(pa.array(texts[20:]))])):
            sets = similarity._sets(own)
            assert sets.lengths.tolist() == [len((t or "").split()) for t in texts]
            assert sets.sizes.tolist() == [len(s) for s in plain] == np.bincount(sets.of, minlength=len(texts)).tolist()
            names = sorted(set().union(*plain))
            place = sets.places(pa.array(names))
            assert sorted(place.tolist()) == list(range(len(names)))
            got = [set() for _ in texts]
            for k, t in zip(sets.of.tolist(), sets.tokens.tolist(), strict=True):
                got[k].add(names[place[t]])
            assert got == plain
    assert similarity._coded(pa.array([], pa.string())).type == similarity._CODED and len(similarity._sets(similarity._coded(pa.array([], pa.string()))).tokens) == 0


def test_no_text_is_shuffled_for_the_words_of_units(spark):
    """Words are made where documents are read, and labels meet their documents in the group: no join, however small a table may be to be broadcast."""
    from prooflake.plans import catalog
    from prooflake.sources import fixtures
    from prooflake.storage import set_for_a_while

    d = "/root/testdata/sf0.001"
    with set_for_a_while(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for name in ("evidence_features", "feature_vectors", "duplicate_rate_by_group", "evidence_pairs_jaccard", "evidence_graph_edges"):
            plan = catalog.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "coded" in plan or "code(" in plan, name
        assert "SortMergeJoin" not in fixtures.instances(spark, d)._jdf.queryExecution().executedPlan().toString()
    units = fixtures.instances(spark, d, cut=3, words=True).selectExpr("inline(evidence_units)").select("text", "words.n").collect()
    whole = fixtures.instances(spark, d).selectExpr("inline(evidence_units)").select("text").collect()
    assert sorted(((u.text, u.n) for u in units), key=str) == sorted(((None if w.text is None else w.text[:3], len((w.text or "").split())) for w in whole), key=str)
