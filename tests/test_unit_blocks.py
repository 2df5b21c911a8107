"""Units of large keys: in rows and blocks, with the results of whole arrays."""

import random

import pytest

from prooflake.operators import features, similarity, unit_blocks

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5])
@pytest.mark.parametrize("block", [8, 1 << 18])
def test_two_halves_meet_as_the_whole(monkeypatch, threshold, block):
    import pyarrow as pa

    monkeypatch.setattr(similarity, "FREQUENT_SETS", 3)
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("a", "bc", "a-longer-word", "ü")) + str(rng.randrange(30)) for _ in range(rng.randrange(25))) for _ in range(60)]
    own, other = (similarity._sets(pa.array(t)) for t in (texts[:25], texts[25:]))
    got = {(int(j), 25 + int(i)): float(r) for block_ in other.met_by(own.index(), own, threshold) for i, j, r in zip(*block_, strict=True)}
    whole = {(int(i), int(j)): float(r) for block_ in similarity._sets(pa.array(texts)).similar(threshold) for i, j, r in zip(*block_, strict=True)}
    assert got == {k: r for k, r in whole.items() if k[0] < 25 <= k[1]}


@pytest.mark.parametrize("size", [1, 200, 5000])
def test_blocks_meet_once(spark, monkeypatch, size):
    """However many blocks a key's units need, every two units meet once, in groups of bounded size; keys without units have a row."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(unit_blocks, "BLOCK_BYTES", size)
    monkeypatch.setattr(unit_blocks, "RUN_BYTES", 500)
    rng = random.Random(4)
    texts = [(k % 2, k, " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(12)))) for k in range(0, 60)] + [(9, 99, "w1 w2")]
    rows = spark.createDataFrame(texts, "key long, uid long, text string")
    units = rows.select("key", "uid", F.lit(None).cast("int").alias("only"), similarity.coded(F.col("text")).alias("words"))
    keys = spark.createDataFrame([(0, ["w1", "zz"], None), (1, ["w2"], 3), (7, [], None)], "key long, asked array<string>, gone long")
    sizes = rows.groupBy("key").agg(F.sum(F.octet_length("text")).alias("bytes"))
    dealt = unit_blocks.dealt(units, sizes, keys, 3).cache()
    most = dealt.where("role = 1").groupBy("key", "block").count().agg(F.max("count")).first()[0]
    assert (dealt.where("key = 0").agg(F.max("block")).first()[0] > 0) == (size < 5000) and (size > 1 or most < 10)
    sets = {k: set(t.split()) for _, k, t in texts}
    wanted = {(key, i, j) for key in (0, 1) for i in range(key, 60, 2) for j in range(i + 2, 60, 2) if len(sets[i] & sets[j]) > 0.5 * len(sets[i] | sets[j])}
    got = [(r.key, r.i, r.j) for r in unit_blocks.similar_pairs(dealt, 0.5).collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    told = unit_blocks.measured(dealt, 0.5, 2, 1).groupBy("key", "state").agg(*(c.alias(n) for n, c in unit_blocks.together().items()))
    found = {(r.key, r.state): (r.n, r.total, r.least, r.similar, r.met) for r in told.collect()}
    own = {(key, s): [(k, t.split()) for q, k, t in texts if q == key and not (s == 1 and key == 1 and k == 3)] for key in (0, 1, 7) for s in (0, 1)}
    asked = {0: {"w1", "zz"}, 1: {"w2"}, 7: set()}
    assert found == {
        (key, s): (sum(bool(t) for _, t in u), sum(len(t) for _, t in u), min((len(t) for _, t in u if t), default=0), len([p for p in wanted if p[0] == key and {p[1], p[2]} <= {k for k, _ in u}]), len(asked[key] & {w for _, t in u for w in t}))
        for (key, s), u in own.items()
    }


def test_no_row_grows_with_the_units_of_an_item(spark, monkeypatch):
    """The queries on units give the same in one block and in many, and no array of units or texts is made."""
    from prooflake.plans import catalog
    from prooflake.sources import fixtures

    names = ("evidence_features", "evidence_pairs_jaccard", "duplicate_rate_by_group", "feature_corr")
    told = lambda: {name: sorted(map(tuple, catalog.queries()[name](spark, D).collect()), key=str) for name in names}
    whole = told()
    monkeypatch.setattr(unit_blocks, "BLOCK_BYTES", 3000)
    assert told() == whole
    wanted = {r.item_id: r.graph_features for r in features.with_features(fixtures.instances(spark, D)).collect()}
    assert {r.item_id: r.graph_features for r in fixtures.featured(spark, D).collect()} == wanted
    for name in names[:3]:
        plan = catalog.queries()[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(struct" not in plan and "collect_list(u" not in plan, name
    assert len(whole["evidence_features"]) == 40


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
@pytest.mark.parametrize("size", [3000, 1 << 24])
def test_states_from_rows_are_those_from_arrays(spark, monkeypatch, size, scale):
    """Features and plain inputs of all four states without an array of units, in one block and in many."""
    from prooflake.operators import assemble
    from prooflake.sources import fixtures

    monkeypatch.setattr(unit_blocks, "BLOCK_BYTES", size)
    d = f"/root/testdata/sf{scale}"
    told = lambda rows: sorted((r.example_id, r.dataset, r.evidence_state_label, r.plain_input, tuple(r.graph_features)) for r in rows.collect())
    got = fixtures.states_featured(spark, d, texts=True)
    assert told(got) == told(assemble.processed(features.all_states_with_features(fixtures.instances(spark, d))))
    short = sorted((r.example_id, tuple(r.graph_features)) for r in fixtures.states_featured(spark, d).collect())
    assert short == [(r[0], r[4]) for r in told(got)] and len({r[2] for r in told(got)}) == 4


@pytest.mark.parametrize("made", ["_detector_rows", "_fused_rows"])
def test_detectors_take_no_arrays_of_units(spark, monkeypatch, made):
    """features_lr and leave_one_dataset_out, training_curve and fused_detector: their rows are made without instances, which hold all units of an item."""
    from prooflake.plans import catalog
    from prooflake.sources import fixtures

    monkeypatch.setattr(fixtures, "instances", None)
    monkeypatch.setattr(fixtures, "_gathered", None)
    rows = getattr(catalog, made)(spark, D)
    whole = rows if made == "_detector_rows" else rows[0].unionByName(rows[1])
    assert whole.groupBy("label").count().count() == 4
