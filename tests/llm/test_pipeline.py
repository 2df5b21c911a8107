"""The pipeline's stages, each on what the one before it kept."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    from prooflake.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs
    return out


def test_stages_keep_the_columns(made):
    columns = made["documents"].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "suffix_dedup", "mix", "tokens"]
    for name in ("quality", "near_dedup", "suffix_dedup", "mix"):
        assert made[name].columns == columns and dict(made[name].dtypes) == dict(made["documents"].dtypes)


def test_quality_drops_what_is_labelled_bad(spark):
    """On a table with enough labels to learn from: the smallest has nine bad ones."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id").collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) / len(good) > 0.95 and sum(i not in kept for i in bad) / len(bad) > 0.8


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_near_copies_go_and_the_rest_stays(made):
    before = {r.doc_id: shingles(r.text) for r in made["quality"].collect()}
    kept = {r.doc_id for r in made["near_dedup"].collect()}
    similarity = {(a, b): len(x & y) / len(x | y) for a, x in before.items() for b, y in before.items() if a < b}
    assert not [p for p, j in similarity.items() if j >= 0.9 and set(p) <= kept]
    near = {i for p, j in similarity.items() if j >= 0.6 for i in p}
    assert all(i in kept for i in before if i not in near)


def test_passages_go_once(made):
    before = {r.doc_id: r.text for r in made["near_dedup"].collect()}
    after = {r.doc_id: r for r in made["suffix_dedup"].collect()}
    seen = set()
    for i in sorted(before):
        raw = before[i].encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            gone[k : k + 100] |= raw[k : k + 100] in seen
            seen.add(raw[k : k + 100])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if kept.strip():
            assert after[i].text == kept and after[i].n_chars == len(kept)
        else:
            assert i not in after or not gone.any()


def test_tokens_follow_the_mix(made):
    import hashlib

    rows = sorted((r.doc_id, r.text) for r in made["mix"].collect())
    got = sorted((r.doc_id, r.decoded_sha256) for r in made["tokens"].collect())
    assert got == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert zlib.crc32(b"") == 0 and made["mix"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_empty_and_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "en", None, 5), (3, "some words here", "en", "s", 15), (3, "some words here", "en", "s", 15), (4, "é" * 300, "fr", "t", 300)]
    from prooflake.llm.common import stored

    clashes = ["rank", "quality_score", "_row", "_copy", "_copies", "a.b", "copy", "n", "text_hash", "rest", "kept", "c0", "first"]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(c) for c in clashes if c != "a.b"}).withColumn("a.b", F.lit("a.b"))
        for name, stage in corpus_pipeline.STAGES:
            columns, docs = docs.columns, stored(stage(spark, docs, SF), "odd")
            if name != "tokens":
                assert docs.columns == columns and all(r[c] == c for r in docs.collect() for c in clashes)
        assert docs.count() <= 3 * len(rows)


def test_equal_ids_with_different_texts_both_stay(spark):
    rows = [(7, "the first text is about rivers and hills in the north"), (7, "another one tells of ships that sail to warm islands"), (None, "the first text is about rivers and hills in the north"), (None, "nobody else says this at all today")]
    rows += [rows[1], rows[3], (9, None), (8, ""), (8, "")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(str, kept)) == sorted(map(str, spark.createDataFrame([rows[0], rows[1], rows[3], (8, "")], "doc_id long, text string").collect()))


def test_mix_keeps_sources_apart_and_chooses_in_order(spark):
    """Rows of one id and text in two sources, and rows that differ in other columns only."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "some words of a text"
    rows = [(100, text, "en", "a", 20), (100, text, "en", "b", 20)]
    got = [tuple(r) for r in corpus_pipeline.mix(spark, spark.createDataFrame(rows, schema), SF).collect()]
    taken = {r.source: r.copies for r in corpus_pipeline.source_mix.mix(spark.createDataFrame(rows, schema)).collect()}
    assert {s: sum(r[3] == s for r in got) for s in "ab"} == taken
    equal = [(7, text, lang, "a", n) for lang, n in (("fr", 1), ("de", 9), ("de", 3), (None, 5))]
    for parts in (1, 4):
        first = corpus_pipeline.near_dedup(spark, spark.createDataFrame(equal, schema).repartition(parts), SF).collect()
        assert [tuple(r) for r in first] == [(7, text, "de", "a", 3)]


def test_mix_meets_targets(made):
    """Words of each source after the stage against the capped targets of what came in."""
    from prooflake.llm import source_mix

    size = lambda rows: {r.source: r.n for r in rows.groupBy("source").agg(F.sum(source_mix.word_count(F.col("text"))).alias("n")).collect()}
    before, after = size(made["suffix_dedup"]), size(made["mix"])
    targets = {r.source: r.target for r in source_mix.source_targets(made["suffix_dedup"].select("source", source_mix.word_count(F.col("text")).alias("size"))).collect()}
    largest = made["suffix_dedup"].agg(F.max(source_mix.word_count(F.col("text")))).first()[0]
    assert set(before) == set(targets) and all(abs(after.get(s, 0) - targets[s]) <= 0.03 * targets[s] + largest for s in targets)


def near_kept(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, SF).collect()}


def test_near_copies_at_the_bound_go(spark):
    """Word edits at 0.80 to 0.82, and copies that repeat a line: the sets decide, however often a shingle occurs."""
    rng, texts, pairs = np.random.default_rng(3), [], []
    line = " ".join(f"line{k}" for k in range(10))
    while len(pairs) < 200:
        words = [f"w{k}" for k in rng.integers(0, 10**6, 300)]
        if len(pairs) % 4 == 0:
            copy = words + [w for _ in range(5 + len(pairs) % 60) for w in line.split()]
        else:
            copy = list(words)
            for at in rng.choice(300, 6 + len(pairs) % 3, replace=False):
                copy[at] = f"edit{rng.integers(10**6)}"
        x, y = " ".join(words), " ".join(copy)
        j = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
        if 0.8 <= j <= 0.82 or len(pairs) % 4 == 0 and j >= 0.8:
            pairs.append((len(texts), len(texts) + 1))
            texts += [x, y]
    kept = near_kept(spark, texts)
    assert kept == {a for a, _ in pairs}


def test_documents_below_the_bound_stay(spark):
    """Pairs at 0.70 to 0.79, bodies that share an often repeated line, and many documents of one template."""
    rng, texts = np.random.default_rng(4), []
    new = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    while len(texts) < 200:
        words = new(300)
        copy = list(words)
        for at in rng.choice(300, 8 + len(texts) // 2 % 3, replace=False):
            copy[at] = f"edit{rng.integers(10**6)}"
        x, y = " ".join(words), " ".join(copy)
        if 0.7 <= len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y)) < 0.79:
            texts += [x, y]
    line, template = new(10), new(256)
    texts += [" ".join(new(300) + line * 20) for _ in range(40)]
    texts += [" ".join(template + new(40)) for _ in range(60)]  # 0.74 of each other, in one large bucket
    copy = texts[-30].split()
    copy[-1] = "changed"
    kept = near_kept(spark, [*texts, " ".join(copy)])
    assert kept == set(range(len(texts)))
