"""Conversation repair, best-fit packing and the prefix trie against brute force."""

import bisect
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prooflake.llm import best_fit, conversation_repair, prefix_trie, registry

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string, digest string, place string, c string, D int"
EMPTY = hashlib.sha256(b"").hexdigest()


def odd_turns(seed, n):
    """Short conversations with nulls, blanks, ties, repeated rows, odd roles and shared beginnings."""
    rng = random.Random(seed)
    texts = [None, "", " \t", "Yes.", "No", "Well?", "Yes.", "é. ", "same", "Same!", "a.b"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "User"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 7)):
            row = (conv if rng.random() < 0.98 else None, rng.choice([turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts), "d", None, "x", 1)
            rows += [row] * (2 if rng.random() < 0.05 else 1)
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_turns(5, 120), CONV).cache()


def frame_dir(tmp_path, df, name="conversations"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# -- 11 ------------------------------------------------------------------------------------------------------------------------


def cheapest(faults, initials):
    """Uniform-cost search over (cost, audit) pairs, with roles instead of states."""
    done = re.compile(r"(s?(ua)+)?\Z")
    open_ = re.compile(r"(s?(ua)*u?)?\Z")
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        short = roles[-1:] + ("s" if roles == "s" else "")
        if (at, short) in seen:
            continue
        seen.add((at, short))
        if at == len(faults) and done.match(roles):
            return cost, audit
        more = [(5, "I", at, roles + r) for r in "ua"]
        if at < len(faults):
            more.append((2, "D", at + 1, roles))
            if faults[at] not in ("blank", "duplicate"):
                extra = 5 if faults[at] == "truncated" else 0
                more.append((extra, "K", at + 1, roles + (initials[at] or "-")))
                more += [(1 + extra, "R", at + 1, roles + r) for r in "ua"]
        for c, letter, to, after in more:
            if open_.match(after):
                heapq.heappush(heap, (cost + c, audit + letter, to, after))
    raise AssertionError


def repaired_by_hand(rows):
    out = {r[0]: [] for r in rows}
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text, *_ in rows:
        roll = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if roll == 1 else re.sub("[.!?]", "", text) if roll == 2 else text
        role = "user" if roll == 4 else role
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        out[conv] += [((turn is not None, turn or 0), role, digest, text, turn)] * (0 if roll == 0 else 2 if roll == 3 else 1)
    found = {}
    for conv, given in out.items():
        given.sort(key=lambda r: (r[0], r[1].encode(), r[2]))
        turns = [r[4] for r in given if r[4] is not None]
        faults, seen = [], set()
        for _, role, _, text, _ in given:
            left = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in given]
        cost, audit = cheapest(faults, [i if i in set("sua") else "" for i in initials])
        lines, at, state = [], 0, ""
        for letter in audit:
            wanted = "assistant" if state == "u" else "user"
            if letter == "I":
                lines.append(f"{wanted}:")
                state = wanted[0]
                continue
            _, role, _, text, _ = given[at]
            at += 1
            if letter == "D":
                continue
            role = wanted if letter == "R" else role
            lines.append(f"{role}:{text}")
            state = role[0]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def as_repairs(rows):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def test_repair_equals_search(spark, odd, tmp_path):
    found = conversation_repair.op11_conversation_repair(spark, frame_dir(tmp_path, odd)).collect()
    assert len(found) == len(as_repairs(found))
    assert as_repairs(found) == repaired_by_hand([tuple(r) for r in odd.collect()])


def test_repair_on_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_repairs(registry.queries()["op11_conversation_repair"](spark, SF).collect()) == repaired_by_hand(rows)


def test_repair_of_empty_table(spark, odd, tmp_path):
    assert conversation_repair.op11_conversation_repair(spark, frame_dir(tmp_path, odd.where("false"))).collect() == []


def test_repair_of_every_short_conversation():
    """All sequences of up to four kinds of rows: least cost, and of equally cheap audits the ASCII-least."""
    kinds = {0: ("", "s"), 1: ("", "u"), 2: ("", "a"), 3: ("", ""), 4: ("truncated", "s"), 5: ("truncated", "u"), 6: ("truncated", "a"), 8: ("blank", "u")}
    rng = random.Random(1)
    cases = [(a,) for a in kinds] + [(a, b) for a in kinds for b in kinds] + [tuple(rng.choices(list(kinds), k=rng.randint(3, 8))) for _ in range(400)]
    for case in cases:
        assert conversation_repair.solve(bytes(case)) == cheapest(*zip(*(kinds[k] for k in case), strict=True)), case


def test_repair_of_a_long_conversation(spark, tmp_path):
    """More rows than a batch, a long text and numbers far apart in one conversation."""
    rows = [(7, k, "user" if k % 2 else "assistant", "long " * 50_000 + "." if k == 50 else f"t{k}.", None, None, None, 1) for k in range(12_000)]
    rows.append((7, 1 << 40, "user", "t1.", None, None, None, 1))
    found = conversation_repair.op11_conversation_repair(spark, frame_dir(tmp_path, spark.createDataFrame(rows, CONV))).first()
    kept = [r for r in rows if zlib.crc32(f"7:{r[1]}".encode()) % 20]
    assert found.gaps == max(r[1] for r in kept) - min(r[1] for r in kept) + 1 - len(kept)
    assert found.cost == conversation_repair.solve(_kinds(rows))[0] and len(found.audit) >= len(kept)


def _kinds(rows):
    out, seen = [], set()
    for conv, turn, role, text, *_ in rows:
        roll = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if roll == 1 else re.sub("[.!?]", "", text) if roll == 2 else text
        role = "user" if roll == 4 else role
        for _ in range(0 if roll == 0 else 2 if roll == 3 else 1):
            left = text.strip()
            out.append(8 if not left or (role, text) in seen else "sua".index(role[0]) + (0 if left[-1] in ".!?" else 4))
            seen.add((role, text))
    return bytes(out)


# -- 12 ------------------------------------------------------------------------------------------------------------------------


def word_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_path())
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def model():
    found = best_fit.WordModel(word_path())
    assert found.plain  # every piece is made by its listed pair, so the fast merges are the file's
    return found


def plain_ids(texts):
    plain = tokenizer()
    return [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_word_ids_equal_tokenizer(model):
    rng = random.Random(2)
    letters = list("abcÀé ñ\n\t 09१中🙂'sT\u0000 ́ \x1c\x85<|>ΣİKaaeett") + ["the", " and", "   ", "'re ", "<|endoftext|>", "don't", "J̌", "ß", "ŉ"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices("aehilnorst", k=rng.randint(1, 30))) for _ in range(20_000)] + ["a" * k for k in range(80)]
    assert best_fit.WordIds(model).encode(texts) == plain_ids(texts)


def test_word_ids_of_every_character(model):
    codes = [*range(0x3100), *range(0xA000, 0xD800, 7), *range(0xF900, 0x10000), *range(0x10000, 0x20000, 11)]
    texts = [f"a{chr(c)}b {chr(c)}C{chr(c)}{chr(c)}" for c in codes]
    assert best_fit.WordIds(model).encode(texts) == plain_ids(texts)


def test_word_ids_without_fast_merges(model):
    slow = best_fit.WordModel(word_path())
    slow.plain = False
    texts = ["Some words, don't ask.", "", "Ünï 🙂 x1y22", "w" * 300]
    assert best_fit.WordIds(slow).encode(texts) == plain_ids(texts)


def test_fast_merges_are_refused_where_they_differ():
    listed = {b"ab": (b"a", b"b"), b"bc": (b"b", b"c"), b"abc": (b"a", b"bc")}
    rank = {piece: k for k, piece in enumerate([b"a", b"b", b"c", *listed])}
    assert best_fit.WordModel._listed(b"bc", listed, rank) and not best_fit.WordModel._listed(b"abc", listed, rank)


def test_word_ids_of_long_texts(model, monkeypatch):
    monkeypatch.setattr(best_fit, "CACHE_BYTES", 10_000)
    texts = ["Some words of a very long text, " * 90_000 + "x" * 30_000, "", "short"] + [f"w{k}" for k in range(500)]
    assert best_fit._encoded(best_fit.WordIds(model), texts) == plain_ids(texts)


def packed_rightly(rows, wanted, capacity):
    """Every piece of every document once, sequences without gaps, overlaps or too many tokens."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in wanted.items()}
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for given in places.values():
        at = 0
        for offset, length in sorted(given):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def pieces_of(texts, capacity):
    plain, out = tokenizer(), defaultdict(list)
    for doc, text in texts:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            out[doc].append((k, at, len(cut), zlib.crc32(cut.tobytes())))
    return out


def test_packing_of_the_given_table(spark):
    rows = registry.queries()["op12_best_fit"](spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = packed_rightly(rows, pieces_of(texts, 4096), 4096)
    assert n == -(-sum(r.length for r in rows) // 4096)  # no packing has fewer


def test_packing_of_odd_rows(spark):
    rng = random.Random(4)
    texts = [(k, "word " * rng.randint(0, 60)) for k in range(300)] + [(None, "no id"), (5, None), (5, None), (6, ""), (7, "<|endoftext|> \x1c x"), (8, "long " * 5000)]
    docs = spark.createDataFrame([(*t, "r", 1) for t in texts], "doc_id long, text string, rank string, part int").repartition(5)
    found = best_fit.pack(docs, word_path(), 64)
    assert packed_rightly(found.withColumn("ids_crc32", F.crc32("ids")).collect(), pieces_of(texts, 64), 64)
    whole = best_fit.sequences(found)
    assert whole.agg(F.max("length"), F.sum("length") * 4 - F.sum(F.length("ids"))).first()[1] == 0
    assert best_fit.pack(docs.where("false"), word_path(), 64).collect() == []


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        n += at == len(gaps) and gap == capacity
        if gap > x:
            bisect.insort(gaps, gap - x)
    return n


def test_plan_has_no_more_sequences_than_best_fit():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([12, 64, 4096])
        lengths = [min(capacity, max(1, int(rng.lognormvariate(rng.uniform(1, 7), 1)))) for _ in range(rng.randint(1, 400))]
        assert best_fit.plan(Counter(lengths), capacity)[1] <= one_by_one(lengths, capacity)


def test_plan_does_not_grow_with_the_documents():
    rng = random.Random(7)
    counts = {rng.randint(1, 4096): rng.randint(1, 9) for _ in range(2000)}
    entries, n = best_fit.plan({x: k * 10**9 for x, k in counts.items()})
    assert len(entries) < 10_000 and n < 1.01 * sum(x * k for x, k in counts.items()) * 10**9 / 4096


def test_plan_fills_each_rank_once():
    rng = random.Random(8)
    for _ in range(40):
        counts = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(25)}
        entries, n = best_fit.plan(counts, 40)
        ranked = {length: sorted(e for e in entries if e[0] == length) for length in counts}
        used = defaultdict(list)
        for length, k in counts.items():
            for rank in range(k):
                _, first, each, at, offset = max(e for e in ranked[length] if e[1] <= rank)
                used[at + (rank - first) // each].append((offset + (rank - first) % each * length, length))
        assert len(used) == n
        for given in used.values():
            given.sort()
            assert given[0][0] == 0 and all(a + x == b for (a, x), (b, _) in zip(given, given[1:], strict=False)) and sum(given[-1]) <= 40


# -- 13 ------------------------------------------------------------------------------------------------------------------------


def trie_by_hand(rows):
    given = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            given[conv].append(((turn is not None, turn or 0), role.encode(), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text.encode()))
    turns = {c: [(r[1], r[3]) for r in sorted(x, key=lambda r: r[:3])] for c, x in given.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    out = []
    for path in members:
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children), leaves, saved, sha))
    return sorted(out, key=lambda r: (r[1], r[0]))


def as_nodes(rows):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows), key=lambda r: (r[1], r[0]))


def test_trie_equals_brute_force(spark, odd):
    assert as_nodes(prefix_trie.trie(odd).collect()) == trie_by_hand([tuple(r) for r in odd.collect()])


def test_trie_of_shared_beginnings_and_copies(spark, monkeypatch):
    """Long common beginnings, ends inside other conversations, copies and several passes."""
    rng = random.Random(9)
    rows = []
    for conv in range(0, 60, 1):
        family = rng.randint(0, 4)
        length = rng.choice([1, 3, 14, 14, 30, 45])
        rows += [(conv, t, "user", f"turn {t} of {0 if t < 9 * family else family}", None, None, None, 1) for t in range(length)]
    monkeypatch.setattr(prefix_trie, "FIRST_TURNS", 2)
    monkeypatch.setattr(prefix_trie, "PACKED", 4)
    df = spark.createDataFrame(rows, CONV)
    assert as_nodes(prefix_trie.trie(df).collect()) == trie_by_hand(rows)


def test_trie_of_copies_alone(spark):
    rows = [(c, t, "user", f"t{t}", None, None, None, 1) for c in range(0, 200, 5) for t in range(12)]
    df = spark.createDataFrame(rows, CONV)
    assert as_nodes(prefix_trie.trie(df).collect()) == trie_by_hand(rows)
    assert prefix_trie.trie(df.where("false")).collect() == []


def test_trie_on_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_nodes(registry.queries()["op13_prefix_trie"](spark, SF).collect()) == trie_by_hand(rows)


def test_words_of_letters_are_not_cut_again():
    """Ids are the tokenizer's for every kind of word; letters only go past the pattern, which took a good part of the time."""
    import public_tokenizers

    from prooflake.llm import best_fit

    coder = best_fit.WordIds(best_fit.WordModel(public_tokenizers.path("word_bpe_49k.json")))
    split, seen = coder.split, []
    coder.split = lambda text: seen.append(text) or split(text)
    texts = ["Some plain words plain", "", "it's a1 İx ªb x" + "y" * 100 + " Some", "x" + "y" * 100, " ", "x" + "y" * 100]
    got = coder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert not any("plain" in x for x in seen) and any("it's" in x for x in seen)
    assert got == coder.encode(texts)
