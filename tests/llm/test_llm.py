"""The training-data operators against brute force on small tables, with nulls, empty and repeated rows, ties and odd columns."""

import base64
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prooflake.llm import audio_features as audio
from prooflake.llm import byte_bpe, chat_collapse, compress_quality, cross_polytope, registry, simhash, source_mix, suffix_dedup, token_counts, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, bucket string, fp string, rid string"
ODD = [None, "", " \n\t", "one", "Straße Ünï 🙂 <|endoftext|>", "\x00\x01 zero", "a" * 5000, "Same text here", "Same text here", "same TEXT here"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and column names that operators use themselves."""
    rows = [(k, t, [None, "s", "t"][k % 3], "b", None, "r") for k, t in enumerate(ODD)]
    rows += [rows[7], (None, "null id", None, None, None, None), (3, "other text under a used id", "s", None, None, None)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


# -- 1 and 3 -------------------------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark, odd, encoding):
    rows = byte_bpe.digest_documents(odd, *byte_bpe.default_vocabulary()).collect()
    texts = [r.text for r in odd.collect()]
    wanted = []
    for t in texts:
        ids = encoding.encode_ordinary(t or "")
        wanted.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(wanted)


def test_bpe_on_random_text(encoding):
    coder = byte_bpe.ByteBpe(*byte_bpe.default_vocabulary())
    rng = np.random.default_rng(3)
    letters = list("abcdeé ñ\n\t  #0९١2中🙂'sT\u0000\u2003<|>") + ["the", " and", "   "]
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(400)]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == encoding.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_token_counts_stitch_blocks(spark, odd, encoding, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", 7)  # most documents cross blocks
    monkeypatch.setattr(token_counts, "GROUP_BLOCKS", 3)
    shards = token_counts.write_shards(odd, *byte_bpe.default_vocabulary())
    counts = token_counts.count_tokens(shards.where("tokens IS NOT NULL"))
    joined = token_counts.manifest(shards).join(counts, ["shard", "ordinal"], "full")
    got = sorted((str(r.doc_id), r.n_tokens) for r in joined.collect())
    assert got == sorted((str(r.doc_id), len(encoding.encode_ordinary(r.text or ""))) for r in odd.collect())


def test_token_stream_without_a_last_separator(spark):
    blocks = spark.createDataFrame([(0, 0, np.array([5, 9, 9], "<u2").tobytes()), (0, 1, np.array([4, 4], "<u2").tobytes())], "shard int, block long, tokens binary")
    assert sorted(map(tuple, token_counts.count_tokens(blocks, 9).collect())) == [(0, 0, 1), (0, 1, 0), (0, 2, 2)]


# -- 2 ---------------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    units = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(u.encode(), seed=42) for u in units]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints, radius):
    """{id: smallest id reachable} by comparing all pairs."""
    ids = sorted(fingerprints)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fingerprints[a] ^ fingerprints[b]).bit_count() <= radius and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_simhash_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (None, 3)}
    got = {r.doc_id: (int(r.fp.hex(), 16), r.component_id) for r in rows if r.doc_id not in (None, 3)}
    assert all(got[i][0] == plain_fingerprint(t) for i, t in texts.items())
    assert got[0][1] == got[1][1] == got[2][1] == 0 and got[7][1] == got[8][1] == got[9][1] == 7


def given_fingerprints(spark, monkeypatch, rows):
    """near_duplicates of rows (doc_id, fingerprint), as (fingerprint, doc_id, component) in order."""
    frame = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for i, v in rows], "doc_id long, fp binary")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: frame)
    return sorted(((int(r.fp.hex(), 16), r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect()), key=str)


@pytest.mark.parametrize(
    ("rows", "components"),
    [
        ([(1, 0), (None, 7), (2, 63)], [1, 1, 1]),  # a row without an id links its neighbours
        ([(5, 0), (None, 1)], [5, 5]),
        ([(None, 0), (None, 1), (4, 1 << 40 | 0xFFFF)], [None, None, 4]),
        ([(5, 0), (5, (1 << 60) - 1), (7, 1), (9, (1 << 60) - 2)], [5, 5, 5, 5]),
        ([(3, 0), (5, 0), (5, (1 << 60) - 1), (7, 1), (9, (1 << 60) - 2)], [3, 3, 5, 3, 5]),  # one id doesn't join its far texts
    ],
)
def test_simhash_null_and_repeated_ids(spark, monkeypatch, rows, components):
    wanted = sorted(((v, i, c) for (i, v), c in zip(rows, components, strict=True)), key=str)
    assert given_fingerprints(spark, monkeypatch, rows) == wanted


def test_simhash_of_null_and_repeated_ids_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    fps = [int(x) for x in rng.integers(0, 1 << 62, 15)]
    for _ in range(120):
        v = fps[int(rng.integers(0, len(fps)))]
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            v ^= 1 << int(b)
        fps.append(v)
    rows = [(None if rng.random() < 0.2 else int(rng.integers(0, 60)), v) for v in fps]
    group = plain_components(dict(enumerate(fps)), 3)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(i, least.get(group[k], i))
    wanted = sorted(((v, i, least.get(group[k])) for k, (i, v) in enumerate(rows)), key=str)
    assert given_fingerprints(spark, monkeypatch, rows) == wanted


def test_simhash_links_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = {}
    for k in range(150):  # chains of near copies, 0 to 4 bits from something earlier
        v = base[k % 12] if k < 24 else fps[int(rng.integers(0, k))]
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            v ^= 1 << int(b)
        fps[k] = v
    wanted = plain_components(fps, 3)
    distinct = {}
    for k, v in fps.items():
        distinct.setdefault(v, k)
    nodes = spark.createDataFrame([(k, bytearray(v.to_bytes(8, "big"))) for v, k in distinct.items()], "node long, fp binary")
    for hot in (20_000, 4):  # also with every bucket split into parts
        monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
        found = {r.node: r.component for r in simhash.components(simhash.links(simhash._keyed(nodes, simhash.exact_tables(3)), 3)).collect()}
        assert all(found.get(k, k) == wanted[k] for k in distinct.values())


@pytest.mark.parametrize("radius", [0, 3, 20, 66])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    bits = rng.integers(0, 2, (200, 128)).astype(np.uint8)
    bits[50:] = bits[rng.integers(0, 50, 150)] ^ (rng.random((150, 128)) < rng.choice([0.0, 0.02, 0.2, 0.4], (150, 1)))
    starts = np.array([0, 1, 4, 90, 91])
    root = simhash.linked(bits, starts, radius)
    label = np.arange(200)
    for a, b in zip(starts, [*starts[1:], 200], strict=True):
        for _ in range(12):
            for i in range(a, b):
                near = np.flatnonzero((bits[a:b] != bits[i]).sum(1) <= radius) + a
                label[near] = np.minimum(label[near], label[i])
    for _ in range(200):
        label = label[label]
    assert [len(set(root[a:b])) for a, b in zip(starts, [*starts[1:], 200], strict=True)] == [len(set(label[a:b])) for a, b in zip(starts, [*starts[1:], 200], strict=True)]


# -- 4 ---------------------------------------------------------------------------------------------------------------------------


def plain_dedup(rows, length=100):
    """rows in document order; (n_bytes, n_removed, n_spans, kept) of each."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            piece = raw[k : k + length]
            if piece in seen:
                gone[k : k + length] = True
            seen.add(piece)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    passages = ["".join(rng.choice(list("abcdé fg"), n)) for n in (60, 99, 100, 101, 150, 400)]
    texts = [None, "", "x" * 99, "x" * 100, "x" * 350, "ab" * 300]
    for _ in range(60):
        parts = [passages[k] if rng.random() < 0.6 else "".join(rng.choice(list("hijk lm"), 70)) for k in rng.integers(0, 6, rng.integers(1, 6))]
        texts.append("".join(parts))
    texts += [texts[10], texts[11], texts[10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    wanted = plain_dedup(texts)
    # also with nearly all windows sent one by one, with texts in pieces, and with an owner's range in many parts
    for often, piece, owner, regroup in ((512, 2 << 20, 8 << 20, 16 << 20), (2, 2 << 20, 8 << 20, 16 << 20), (512, 130, 300, 3000), (3, 2 << 20, 300, 1)):
        monkeypatch.setattr(suffix_dedup, "MOST_OWNERS", 3)
        monkeypatch.setattr(suffix_dedup, "OWNER_BYTES", owner)
        monkeypatch.setattr(suffix_dedup, "REGROUP_BYTES", regroup)
        monkeypatch.setattr(suffix_dedup, "FREQUENT", often)
        monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
        monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(docs).collect()}
        assert [got[k] for k in range(len(texts))] == wanted


def test_suffix_dedup_odd_rows(spark, odd, empty):
    rows = suffix_dedup.deduplicate(odd.withColumn("a.b", F.lit("dot")).withColumn("kept", F.lit(1))).collect()
    assert all(r.rest["a.b"] == "dot" and r.rest.kept == 1 for r in rows)
    assert len(rows) == odd.count() and suffix_dedup.deduplicate(empty).count() == 0
    long = next(r for r in rows if r.n_bytes == 5000)
    assert (long.n_removed, long.n_spans) == (4999, 1) and long.rest.bucket == "b"


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 4):
        base = bytes(rng.integers(97, 97 + letters, 800, dtype=np.uint8))
        text = base + base[100:700] + b"ab" * 150 + base[:300]
        x = np.frombuffer(text, np.uint8)
        sa, rank = suffix_dedup.suffix_array(x)
        order = sorted(range(len(text)), key=lambda i: (text[i : i + 128], i))
        assert sa.tolist() == order
        equal = [False] + [text[a : a + 100] == text[b : b + 100] and max(a, b) + 100 <= len(text) for a, b in zip(order, order[1:], strict=False)]
        assert suffix_dedup.common_prefixes(x, sa, rank).tolist() == equal


def passage_routes(spark, monkeypatch, n):
    """What shards send for n documents of their own text around one passage that is shorter than a window."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 40_000)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 40_000)
    rng = np.random.default_rng(n)
    passage = "".join(rng.choice(list("abcdefgh"), 92))
    own = lambda: "".join(rng.choice(list("ijklmnopqrstuvwxyz"), 150))
    texts = suffix_dedup.split_copies(spark.createDataFrame([(k, own() + passage + own()) for k in range(n)], "doc_id long, text string"))
    replies = suffix_dedup.repeated_anchors(texts.single, 4)
    return suffix_dedup.shard_rows(texts.single, replies, 4).collect(), texts


def test_a_passage_of_many_documents_is_no_hot_group(spark, monkeypatch):
    """Its windows all differ, so they must spread: no key holds more than one of them, however many documents there are."""
    for n in (600, 2400):
        rows, texts = passage_routes(spark, monkeypatch, n)
        sizes = [len(np.frombuffer(r.meta, suffix_dedup.WINDOW)) for r in rows if r.kind == 2]
        keys = [(w["h1"], w["h2"]) for r in rows if r.kind == 2 for w in np.frombuffer(r.meta, suffix_dedup.WINDOW)]
        assert len(keys) >= n and len(set(keys)) == len(keys) and not [r for r in rows if r.kind == 0]
        assert {r.owner for r in rows if r.kind == 2} == {0, 1, 2, 3} and max(sizes) < 2 * min(sizes)  # evenly over the owners
        assert sum(len(np.frombuffer(r.meta, suffix_dedup.RUN)) for r in rows if r.kind == 1) < n
    assert suffix_dedup.removed_ranges(texts).count() == 0


def test_what_a_batch_sends_stays_constant(spark, monkeypatch):
    """From 1 to 100 times the text a batch sends a row to each owner at most, and each part of an owner's range stays small."""
    monkeypatch.setattr(suffix_dedup, "MOST_OWNERS", 16)
    monkeypatch.setattr(suffix_dedup, "OWNER_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 8000)
    monkeypatch.setattr(suffix_dedup, "BATCHES", 1 << 30)  # batches of one size, so that rows can be compared
    monkeypatch.setattr(suffix_dedup, "REGROUP_BYTES", 100_000)
    rng, sent, largest = np.random.default_rng(5), [], []
    for times in (1, 10, 100):
        texts = [(k, bytes(rng.integers(97, 123, 2000, dtype=np.uint8)).decode()) for k in range(20 * times)]
        single = suffix_dedup.split_copies(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
        owners, parts = suffix_dedup.layout(single.bytes, 4)
        assert owners == 16 and parts == -(-single.bytes // 2000 // 16)
        rows = suffix_dedup.anchor_rows(single.single, owners).groupBy("batch").count().collect()
        sent.append(max(r["count"] for r in rows))
        named = suffix_dedup.anchor_rows(single.single, owners).select("owner", F.col("batch").alias("name"), F.col("anchors").alias("meta"), F.lit(None).cast("binary").alias("body"))
        ranged = suffix_dedup.by_range(named, suffix_dedup.ENTRY, owners, parts).select("part", F.expr("aggregate(metas, 0, (n, m) -> n + octet_length(m))").alias("n"))
        sizes = [r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()]
        assert len(sizes) == owners * parts
        largest.append(max(sizes))
    assert sent == [16, 16, 16] and max(largest) < 2.5 * min(largest)
    assert suffix_dedup.removed_ranges(single).count() == 0


def test_batches_grow_with_the_corpus():
    assert [suffix_dedup.batch_bytes(n) for n in (0, 30 << 30, 1 << 40)] == [2 << 20, 2 << 20, 32 << 20] and suffix_dedup.batch_bytes(100 << 40) == 32 << 20
    assert suffix_dedup.layout(0, 8) == (8, 1) and suffix_dedup.layout(30 << 30, 8) == (3840, 1)
    assert suffix_dedup.layout(100 << 40, 8) == (4096, 3200) and suffix_dedup.layout(1 << 30, 10_000) == (10_000, 1)


def test_merge_of_shards_equals_brute_force_when_hashes_collide(monkeypatch):
    """With hashes of very few values the merge by binary search gives up and one suffix array decides."""
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 100, 120, dtype=np.uint8)) for _ in range(6)]
    metas, bodies, texts = [], [], []
    for s in range(4):
        some = [words[k][a : a + 110] for k, a in zip(rng.permutation(6)[:3], rng.integers(0, 10, 3), strict=True)]
        meta = np.zeros(3, suffix_dedup.RUN)
        meta["doc"], meta["rid"], meta["size"] = range(3 * s, 3 * s + 3), range(3 * s, 3 * s + 3), 110
        metas.append(meta)
        bodies.append(b"".join(some))
        texts += some
    seen, wanted = set(), set()
    for rid, t in enumerate(texts):
        for k in range(11):
            if t[k : k + 100] in seen:
                wanted.add((rid, k))
            seen.add(t[k : k + 100])
    spread = lambda found: {(int(r), k) for r, a, b in zip(*found, strict=True) for k in range(a, b - 99)}
    assert spread(suffix_dedup.merge_runs(metas, bodies)) == wanted
    monkeypatch.setattr(suffix_dedup, "block_hashes", lambda x, size, kind=0: np.arange(len(x), dtype=np.uint64) % np.uint64(3))
    assert spread(suffix_dedup.merge_runs(metas, bodies)) == wanted


# -- 5 ---------------------------------------------------------------------------------------------------------------------------


def plain_sainte_lague(claims, seats):
    won = [0] * len(claims)
    for _ in range(seats):
        k = max(range(len(claims)), key=lambda i: (claims[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


@pytest.mark.parametrize("claims", [[5.0, 3.0, 1.0], [4.0, 4.0, 4.0, 4.0], [0.4, 0.4, 10.2], [1.0], [100.5, 33.3, 7.7, 1.1, 0.2]])
def test_sainte_lague(spark, claims):
    frame = spark.createDataFrame([(f"p{k}", k, c) for k, c in enumerate(claims)], "source string, shard long, claim double")
    for seats in (0, 1, 2, 3, 7, 11, 50):
        got = [r.quota for r in source_mix.sainte_lague(frame, seats).orderBy("shard").collect()]
        assert got == plain_sainte_lague(claims, seats)


def plain_targets(sizes):
    """sizes by source; targets by capping again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left, share = total - sum(capped.values()), sum(w for s, w in weight.items() if s not in capped)
        target = {s: capped[s] if s in capped else left * w / share for s, w in weight.items()}
        new = [s for s in names if s not in capped and target[s] > 3 * sizes[s] + 1e-9]
        if not new:
            return target
        capped |= {s: 3.0 * sizes[s] for s in new}


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(4)
    rows, sizes = [], {}
    for k in range(600):
        source = [None, "a", "b", "c", "tiny"][0 if k % 40 == 0 else 4 if k % 97 == 0 else 1 + k % 3]
        n = int(rng.integers(0, 400))
        sizes[source] = sizes.get(source, 0) + n
        rows.append((k, " \t".join("w" * n), source))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix(frame).collect()
    again = source_mix.mix(frame.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    target = plain_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in own) - target[s]) <= source_mix.BLOCK_TOKENS
    assert all(0 <= r.taken <= 3 * r.size for r in got)


def test_copies_of_the_mix_come_near_the_target(spark):
    rng = np.random.default_rng(9)
    frame = spark.createDataFrame([(k, " ".join(["w"] * int(rng.integers(1, 600))), "abc"[min(2, k % 7)]) for k in range(1200)], "doc_id long, text string, source string")
    rows = source_mix.mix(frame).collect()
    for s in "abc":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) < 0.02 * own[0].target
    assert all(0 <= r.copies <= 3 for r in rows)


def test_equal_rows_fall_into_many_shards(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "COPIES_AT_ONCE", 7)
    frame = spark.createDataFrame([(1, "one two three", "s")] * 100 + [(None, "w " * 400, "s")] * 300 + [(2, "x " * 10, "t")], "doc_id long, text string, source string")
    rows = source_mix.mix(frame).collect()
    assert len(rows) == 401 and abs(sum(r.taken for r in rows if r.source == "s") - rows[0].target) <= source_mix.BLOCK_TOKENS or len({r.source for r in rows}) == 2
    for s in "st":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= source_mix.BLOCK_TOKENS * 2


def test_mix_odd_rows(spark, odd, empty):
    rows = source_mix.mix(odd).collect()
    assert len(rows) == odd.count() and source_mix.mix(empty).count() == 0
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for r in rows for t in [next(x.text for x in odd.collect() if x.doc_id == r.doc_id)] if r.doc_id not in (None, 3))


# -- 6 ---------------------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, odd, empty):
    rows = audio.media_digests(audio.media_features(odd)).collect()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (None, 3)}
    for r in rows:
        if r.doc_id in texts:
            raw = (texts[r.doc_id] or "").encode()
            payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = [r for r in rows if r.doc_id in (7, 8)]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1
    assert audio.media_digests(audio.media_features(empty)).count() == 0


def test_features_do_not_depend_on_pieces(monkeypatch):
    payload = audio.padded(b"The quick brown fox jumps over the lazy dog. " * 200)
    whole = audio.Extractor().features(payload)
    monkeypatch.setattr(audio, "PIECE_FRAMES", 5)
    pieces = audio.Extractor().features(payload)
    assert np.allclose(whole.logmel, pieces.logmel) and whole.segments == pieces.segments


def test_resampling_keeps_a_tone():
    t = np.arange(8000)
    tone = np.round(128 + 100 * np.sin(2 * np.pi * 300 * t / audio.RATE)).astype(np.uint8)
    got = audio.Extractor().resampled(tone, 0, 6000)
    wanted = 100 / 128 * np.sin(2 * np.pi * 300 * np.arange(6000) * audio.DOWN / audio.UP / audio.RATE)
    assert np.abs(got - wanted)[50:-50].max() < 0.03


def test_tensors_and_segments(spark, odd):
    for r in audio.media_features(odd).collect():
        batch = audio.from_ipc(bytes(r.tensors))
        assert batch.column("logmel").type.shape == [audio.CLIP_FRAMES, audio.BANDS] and len(audio.read_wav(bytes(r.media))) % 64 == 0
        assert batch.column("start_s")[0].as_py() == 0.0
    energy = np.array([0.0, -20, -7, -5, -7, -11, -13, -7, -3])
    step = audio.HOP * audio.DOWN / audio.UP / audio.RATE
    assert audio.segments_of(energy) == [(0.0, step), (3 * step, 6 * step), (8 * step, 9 * step)]


def plain_feature(payload):
    """The feature string by loops over samples, frames and bands."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n, phases = len(x) * audio.UP // audio.DOWN, audio.resampling_filter()
    y = np.zeros(max(n, audio.FRAME) + 2 * audio.FRAME)
    frames = max(1, -(-(n - audio.FRAME) // audio.HOP) + 1)
    for m in range((frames - 1) * audio.HOP + audio.FRAME):
        at, phase = divmod(m * audio.DOWN, audio.UP)
        y[m] = sum(phases[phase][t] * x[i] for t in range(audio.TAPS) if 0 <= (i := at - audio.TAPS // 2 + 1 + t) < len(x))
    top = audio.RATE * audio.UP / audio.DOWN / 2
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), audio.BANDS + 2) / 2595) - 1)
    logmel, energy = [], []
    for f in range(frames):
        piece = y[f * audio.HOP : f * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME)
        wave = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)) / audio.FRAME) @ piece
        row = []
        for b in range(audio.BANDS):
            lo, mid, hi = edges[b : b + 3]
            hertz = np.arange(audio.FRAME // 2 + 1) * top / (audio.FRAME // 2)
            row.append(np.log10(max(1e-10, sum(abs(w) ** 2 * max(0.0, min((h - lo) / (mid - lo), (hi - h) / (hi - mid))) for w, h in zip(wave, hertz, strict=True)))))
        logmel.append(row)
        energy.append(10 * np.log10(max(1e-10, float((piece**2).mean()))))
    return np.array(logmel), np.array(energy)


def test_log_mel_equals_plain_loops():
    payload = audio.padded(b"Pack my box with five dozen liquor jugs. " * 20)
    found, (logmel, energy) = audio.Extractor().features(payload), plain_feature(payload)
    assert np.allclose(found.logmel, logmel, atol=1e-6) and np.allclose(found.energy, energy, atol=1e-6)
    clips = audio.from_ipc(audio.to_ipc(audio.clip_tensors(found.logmel)))
    said = audio.summary(clips, found.segments, float(found.energy.max()))
    means = [float(b.split("~")[0]) for b in said.split("bands=")[1].split(",")]
    assert np.allclose(means, logmel.mean(0), atol=0.006) and f"frames={len(logmel)};clips={-(-len(logmel) // audio.CLIP_FRAMES)};segments={len(found.segments)};" in said


# -- 7 ---------------------------------------------------------------------------------------------------------------------------


def plain_verdict(host, path):
    fits = [(h.count("."), len(p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_urls(spark):
    hosts = ["com", "a.com", "example.com", "EXAMPLE.com", "x.example.com", "example.net", "net", "b.net", "org", "xcom", "", "com.", "a.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/7/x", "/en/78", "/de/", "/de/8", "/de/88/x", "/es/a?b", "/de/#8", "?/en/", "//en/7"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "a://b://c/en/"]
    rows = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.RULES).collect()
    for r in rows:
        rest = (urls[r.page_id] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest)[0][len(host) :]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *plain_verdict(host, path))


def test_many_rules_are_joined(spark, monkeypatch):
    """The way for lists that can't be broadcast gives the same rows; repeated rows, other columns and an empty table are fine."""
    hosts = ["com", "a.com", "EXAMPLE.com", "x.example.com", "example.net", "b.net", "", "com."]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/78/x", "/de/8", "/de/88/x?/en/", "//en/7"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "http://com/en/7"]
    frame = spark.createDataFrame([(k % 50, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rules = [*url_filter.RULES, ("com", "", "allow"), ("net", "/", "block"), ("a.com", "/en", "block")]
    wanted = sorted(map(str, url_filter.judge_urls(frame, rules).collect()))
    monkeypatch.setattr(url_filter, "MOST_RULES", 3)
    assert sorted(map(str, url_filter.judge_urls(frame, rules).collect())) == wanted
    assert url_filter.judge_urls(frame.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge_urls(frame, [*rules, rules[0]]).count()


def test_equal_rules_are_refused():
    with pytest.raises(ValueError):
        url_filter.build_trie([("com", "/a", "allow"), ("com", "/a", "block")])


# -- 8 ---------------------------------------------------------------------------------------------------------------------------


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [-1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = cross_polytope.usable(frame, "vec_id", "embedding")
    got = [(r.vec_id, r.score) for r in cross_polytope.nearest(usable.where("id = 0"), usable).orderBy("rank").collect()]
    assert got == [(6, 0.0), (7, 0.0), (10, pytest.approx(0.5**0.5)), (8, 2.0)]
    assert cross_polytope.nearest(usable.where("id < 0"), usable.where("id < 0")).count() == 0


def test_recall(spark):
    rows = cross_polytope.op8_cross_polytope(spark, SF).collect()
    vectors = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    hits = total = 0
    for q in (i for i in vectors if i % 100 == 0):
        near = sorted((float(np.sqrt(((v - vectors[q]) ** 2).sum())), i) for i, v in vectors.items() if i != q)[:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [k for k, _, _ in own] == list(range(1, 11)) and [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hits, total = hits + len({i for _, i in near} & {i for _, i, _ in own}), total + 10
    assert hits / total >= 0.9


def test_repeated_ids_leave_their_places_to_others(spark):
    """An id repeated more than k times, with equal and with different vectors, counts once in every cell part."""
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(1, [1.0, 0.001, 0.0, 0.0])] * 12 + [(2, [1.0, 0.002 + k * 1e-5, 0.0, 0.0]) for k in range(12)]
    rows += [(10 + k, [1.0, 0.01 * (k + 1), 0.0, 0.0]) for k in range(12)]
    frame = spark.createDataFrame(rows, "id long, vec array<double>")
    got = [(r.vec_id, r.score) for r in cross_polytope.nearest(frame.where("id = 0"), frame, k=10).orderBy("rank").collect()]
    assert [i for i, _ in got] == [1, 2, *range(10, 18)]
    assert [s for _, s in got] == pytest.approx([0.001, 0.002, *(0.01 * (k + 1) for k in range(8))])


def test_vectors_of_very_different_lengths(spark):
    """Squares of finite components may leave the range of doubles; no row is lost, and distances are right."""
    big, small = 1e200, 1e-200
    rows = [(0, [big, 0.0, 0.0]), (1, [big, big, 0.0]), (2, [0.0, big, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [small, small, 0.0])]
    frame = spark.createDataFrame(rows, "id long, vec array<double>").withColumn("tab", F.lit(1)).withColumn("part", F.lit("x"))
    got = [(r.vec_id, r.score) for r in cross_polytope.nearest(frame.where("id = 0"), frame).orderBy("rank").collect()]
    assert got[0] == (1, big) and {i for i, _ in got[:3]} == {1, 3, 4} and got[3] == (2, pytest.approx(2**0.5 * big)) and len(got) == 4
    near = [(r.vec_id, r.score) for r in cross_polytope.nearest(frame.where("id = 4"), frame.where("id > 2")).collect()]
    assert near == [(3, pytest.approx(1.0))]
    assert cross_polytope.distances(np.array([[3 * small, 4 * small], [0.0, 0.0]]), np.zeros(2)).tolist() == [pytest.approx(5 * small), 0.0]


@pytest.mark.parametrize("spread", [None, 0.3])
def test_recall_and_candidates(spark, spread):
    """Against brute force, on directions without structure and around a few centres, at n and 5 n rows."""
    rng, shares = np.random.default_rng(6), []
    for n in (1500, 7500):
        x = rng.standard_normal((n, 24)) if spread is None else rng.standard_normal((n // 50, 24)).repeat(50, 0) + spread * rng.standard_normal((n, 24))
        x = np.concatenate([x, x[:1]])  # a tie
        frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<float>")
        x = x.astype(np.float32).astype(np.float64)
        queries = frame.where("id % 25 = 0")
        settings = cross_polytope.fit(queries, frame, 10)
        shares.append(settings.candidates)
        hits = total = 0
        found = {}
        for r in cross_polytope.nearest(queries, frame, 10, settings).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        for q, got in found.items():
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            hits += len(got & set(np.argsort(d, kind="stable")[:10].tolist()))
            total += 10
        assert len(found) == -(-len(x) // 25) and hits / total >= 0.93, (spread, n, hits / total, settings)
    assert shares[1] < shares[0], shares  # candidates grow more slowly than rows


def test_rotation_is_orthogonal():
    y = cross_polytope.rotate(np.eye(48), 0)
    assert np.allclose(y @ y.T, np.eye(48))


# -- 9 ---------------------------------------------------------------------------------------------------------------------------


def plain_collapse(rows):
    whole = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        whole.setdefault(conv, []).append((role, text))
    first = {}
    for conv in sorted(whole, key=lambda c: (c is None, c)):
        first.setdefault(tuple(whole[conv]), conv)
    return {conv: len(turns) for turns, conv in first.items() if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in first)}


def test_snapshots_collapse(spark, monkeypatch):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "a"), (4, 1, "assistant", "c"), (5, 0, "user", None), (6, 0, "user", ""), (6, 3, None, "x<|y|>"), (7, None, "user", "a")]
    rows += [(None, 0, "system", "s"), (8, 0, "user", "long"), *((8, k, "user", f"t{k}") for k in range(1, 40)), *((9, k, "user", f"t{k}" if k else "long") for k in range(20))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("x")).withColumn("base", F.lit(1))
    for group, hot in ((256, 100_000), (3, 100_000), (256, 1)):
        monkeypatch.setattr(chat_collapse, "TURN_GROUP", group)
        monkeypatch.setattr(chat_collapse, "HOT_ROWS", hot)
        got = chat_collapse.collapse(frame).collect()
        assert {r.conv_id: r.n_turns for r in got} == plain_collapse(rows) == {2: 2, 4: 2, 5: 1, 6: 2, 8: 40, None: 1}
    assert next(r.rendered for r in got if r.conv_id == 6 and r.position == 2) == "<|unknown|>\nx< |y|>\n<|end|>\n"
    assert chat_collapse.collapse(frame.limit(0)).count() == 0


def test_many_rows_of_one_turn_are_split(spark, monkeypatch):
    """Equal turn numbers, and none at all: the order is by role and content, however groups are split."""
    rows = [(1, None, ["user", None, "assistant"][k % 3], f"t{k % 40}") for k in range(120)] + [(2, 5, "user", f"x{k}") for k in range(50)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(str, chat_collapse.collapse(frame).collect()))
    monkeypatch.setattr(chat_collapse, "HOT_ROWS", 10)
    assert sorted(map(str, chat_collapse.collapse(frame).collect())) == whole and len(whole) == 170
    groups = chat_collapse.hashed(frame).groupBy("conv_id", "grp").count()
    assert groups.count() > 60


# -- 10 --------------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in compress_quality.op10_compress_quality(spark, sf).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.9


def test_scores_by_zstandard_alone(spark):
    """Scores recomputed from the model's parts: dictionaries, slope, offset, half and the share of good labels."""
    import math

    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = compress_quality.train(spark, docs.select("doc_id", "text"), SF)
    coders = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in (model.bad, model.good)]
    for r in compress_quality.score_documents(docs.select("doc_id", "text"), model).collect():
        raw = (r.text or "").encode()
        bad, good = (sum(len(c.compress(raw[k : k + 1024])) for k in range(0, len(raw), 1024)) for c in coders)
        trust = len(raw) / (len(raw) + model.half) if raw else 0.0
        z = trust * (model.slope * (bad - good) / max(1, len(raw)) + model.offset) + (1 - trust) * model.prior
        assert r.quality_score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_long_labelled_texts_are_learnt_in_part(spark, monkeypatch):
    monkeypatch.setattr(compress_quality, "SAMPLE_BYTES", 3 * compress_quality.TRAIN_CHUNK)
    text = "".join(f"{k:06d}," for k in range(3000))  # 21,000 bytes
    docs = spark.createDataFrame([(k, text if k == 1 else f"short {k}" if k < 9 else None) for k in range(1, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 12)], "doc_id long, quality int")
    sample, counts = compress_quality.labelled_sample(docs, labels)
    long = next(t for _, t in sample if len(t) > 100)
    chunk = compress_quality.TRAIN_CHUNK
    pieces = [text.encode()[k : k + chunk] for k in range(0, len(text), chunk)]
    at = [pieces.index(long[k : k + chunk]) for k in range(0, len(long), chunk)]
    assert len(at) == 3 and at == sorted(at) and sum(counts) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(1, 12))
    assert len(sample) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(1, 9))


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Each narrow operator runs where only the driver can import the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
from prooflake.llm import registry
q = registry.queries()
for name in ('op1_byte_bpe', 'op6_audio_features', 'op7_url_filter', 'op8_cross_polytope', 'op10_compress_quality', 'op2_simhash'):
    assert q[name](spark, {SF!r}).count() > 0, name
print('all ran')
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_quality_of_odd_rows(spark, odd, empty):
    docs = odd.select("doc_id", "text")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    model = compress_quality.fit_model(*compress_quality.labelled_sample(docs, labels))
    scored = compress_quality.score_documents(odd, model)
    assert scored.count() == odd.count() and scored.columns == [*odd.columns, "quality_score"]
    assert compress_quality.score_documents(empty, model).count() == 0


# -- edges -----------------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    vocabulary = byte_bpe.default_vocabulary()
    assert byte_bpe.digest_documents(empty, *vocabulary).count() == 0 and token_counts.count_documents(empty, *vocabulary).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_copies(empty).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.RULES).count() == 0
    vectors = cross_polytope.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert cross_polytope.nearest(vectors, vectors).count() == 0


def test_token_counts_of_odd_rows(odd, encoding):
    rows = token_counts.count_documents(odd, *byte_bpe.default_vocabulary()).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(r.doc_id), len(encoding.encode_ordinary(r.text or ""))) for r in odd.collect())


def test_memory_of_pre_tokens_is_bounded(encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 5000)
    monkeypatch.setattr(byte_bpe, "LONG_TOKEN", 50)
    coder = byte_bpe.ByteBpe(*byte_bpe.default_vocabulary())
    for k in range(30):
        texts = [f"word{k}x{j} " * 3 + "y" * (40 + 3 * j) for j in range(10)]
        for text, ids in zip(texts, coder.encode(texts), strict=True):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == encoding.encode_ordinary(text)
        assert coder.held <= 5000 + 30 * (50 + 400 + byte_bpe.ENTRY_BYTES)


def test_running_sums(spark):
    from prooflake.llm.common import running

    rng = np.random.default_rng(1)
    rows = [(int(k), int(v)) for k, v in zip(rng.permutation(300), rng.integers(0, 9, 300), strict=True)]
    got = {r.k: (r.place, r.total) for r in running(spark.createDataFrame(rows, "k long, v long").repartition(5), [F.col("k")], {"place": F.lit(1), "total": F.col("v")}).collect()}
    value = dict(rows)
    assert all(got[k] == (k, sum(value[j] for j in range(k))) for k in range(300))


def test_groups_and_buckets_that_are_split(spark, monkeypatch):
    """near_copies gives the same classes with every bucket and group in parts."""
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(8):
        base = [f"w{k}" for k in rng.integers(0, 10**6, 60)]
        for k in range(12):
            copy = list(base)
            copy[int(rng.integers(60))] = f"e{rng.integers(10**6)}"
            if k % 4 == 3:  # far from most, near to another that is far
                copy = texts[-1].split()
                copy[7] = copy[40] = f"f{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(label)
        for a in range(len(texts)):
            for b in range(a):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    for bucket, size in ((20_000, 32 << 20), (3, 3000), (20_000, 400), (20_000, 12_000)):
        monkeypatch.setattr(simhash, "HOT_BUCKET", bucket)
        monkeypatch.setattr(simhash, "HOT_BYTES", size)
        rows = simhash.near_copies(frame).collect()
        assert [r.component_id for r in sorted(rows)] == label
        assert {r.doc_id for r in rows if r.first} == set(label)


def test_copies_of_one_text_need_no_cells(spark, monkeypatch):
    """A group of n copies that are all linked to its hub costs n comparisons, however small the parts are."""
    rng = np.random.default_rng(13)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 80)]
    texts = [" ".join(base)]
    for _ in range(300):
        copy = list(base)
        copy[int(rng.integers(80))] = f"e{rng.integers(10**9)}"
        texts.append(" ".join(copy))
    rows = [(k, 5, simhash.majority(h, simhash.COPY_WORDS), h.tobytes()) for k, h in enumerate(simhash.shingle_set(t.encode(), 5) for t in texts)]
    monkeypatch.setattr(simhash, "HOT_BYTES", 2000)
    cells, edges = simhash._hot_cells(spark.createDataFrame(rows, "node long, component long, fp binary, hashes binary"), simhash.SIMILAR)
    found = edges.collect()
    assert len(found) == 300 and all(r.a == 0 for r in found) and cells.count() == 0
    # short texts: the 99 beside the hub have 792 bytes of sets, one part, but with their nodes 26,136 bytes, 27 parts of half of HOT_BYTES
    short = [(k, 5, simhash.majority(h, simhash.COPY_WORDS), h.tobytes()) for k, h in enumerate(simhash.shingle_set(f"a b {k}".encode(), 5) for k in range(100))]
    cells, edges = simhash._hot_cells(spark.createDataFrame(short, "node long, component long, fp binary, hashes binary"), simhash.SIMILAR)
    assert edges.count() == 0 and cells.where("cell.two").count() == 99 + 27  # each of the others meets the hub, which goes to all their parts
    found = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0} and [r.doc_id for r in found if r.first] == [0]


# -- all -------------------------------------------------------------------------------------------------------------------------


def test_queries_and_sql(spark):
    import duckdb

    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()} == set(range(1, 14))
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got, wanted = registry.queries()[name](spark, SF), con.sql(sql)
        order = sorted(got.columns)
        at = [wanted.columns.index(c) for c in order]
        assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=str) == sorted((tuple(r[k] for k in at) for r in wanted.fetchall()), key=str)
