"""Conversation structure repair: the cheapest edits that make turn roles alternate, found by Dial's shortest paths.

A conversation of n rows is a graph with a node for each place 0..n and each state of the wanted order `(s?(ua)+)?`. Arcs keep, rerole or
delete a row, or insert one; costs are small whole numbers, so the distances to the end come from a circular queue of COSTLIEST + 1 buckets
instead of a heap. From the start, the least letter whose arc is tight (distance = cost + distance behind it) is then walked: that is the
ASCII-least audit of the least cost, as a letter and a state give one arc.

Texts don't take part in that. Rows first go as a digest and a few flags, equal ones counted before the shuffle; earlier equal turns come from an
aggregation by conversation and digest, which spreads one large conversation over all tasks. What a task holds of a conversation is a byte a
row, as the audit, a single value, has a letter a row. Texts are shuffled once and stream through behind their conversation's audit;
a task never holds more than one batch of them. (A conversation's SHA-256 has to read its repaired rows in order, in one task.)

Rows: turns are ordered by turn (null first), then role, then the digest of role and text, so ties have a defined order; null roles and texts count as
one space, and in the key of the damage a null conv_id or turn does. Rows without a conv_id are one conversation. A role counts by its
first character as it stands ("User" and "" are none of s, u, a and can only be reroled or deleted). Repeated rows are duplicates. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prooflake.llm.common import runs, stored, table

#: Costs of the edits; a truncated row that stays adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
COSTLIEST = max(INSERT, DELETE, REROLE + TRUNCATED)
#: States of the wanted order: nothing yet, after a system turn, after a user turn, after an assistant turn. Done: first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or reroled turn leads to, and its role.
FILLED = (USER, USER, ASSISTANT, USER)
FILLED_ROLE = ("user", "user", "assistant", "user")
#: Kinds of rows: role initial (s, u, a, other), +4 if truncated; FORCED rows must go.
OTHER, CUT, FORCED = 3, 4, 8
#: Whole turns by initial: the state that a kept row leads to from each state, or none.
KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None, None, None, None))
#: A task remembers the audits of so many conversations of up to SHORT rows by their kinds of rows.
SHORT, REMEMBERED = 64, 1 << 16
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096
WHITE = " \t\n\x0b\x0c\r"


def _arcs() -> tuple:
    """For each kind of row and each state behind it: the (state before, cost) of the arcs that use the row."""
    table_ = []
    for kind in range(FORCED + 1):
        into: list[list[tuple[int, int]]] = [[] for _ in range(4)]
        more = TRUNCATED if kind < FORCED and kind & CUT else 0
        for state in range(4):
            into[state].append((state, DELETE))
            if kind < FORCED:
                if (kept := KEPT[kind & 3][state]) is not None:
                    into[kept].append((state, KEEP + more))
                into[FILLED[state]].append((state, REROLE + more))
        table_.append(tuple(map(tuple, into)))
    return tuple(table_)


ARCS = _arcs()
INSERTS = tuple(tuple(s for s in range(4) if FILLED[s] == state) for state in range(4))


def distances(kinds: bytes) -> array:
    """Least cost from each node (4 * place + state) to the end, by Dial's queue backwards from the end. Nodes farther than the
    start are left at a bound above it."""
    n = len(kinds)
    dist = array("i", [(1 << 31) - 1]) * (4 * (n + 1))
    queue: list[list[int]] = [[] for _ in range(COSTLIEST + 1)]
    for state in (START, ASSISTANT):
        dist[4 * n + state] = 0
        queue[0].append(4 * n + state)
    level, waiting = 0, 2
    while waiting:
        bucket = queue[level % (COSTLIEST + 1)]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != level:
                continue
            at, state = node >> 2, node & 3
            for s in INSERTS[state]:
                if level + INSERT < dist[4 * at + s]:
                    dist[4 * at + s] = level + INSERT
                    queue[(level + INSERT) % (COSTLIEST + 1)].append(4 * at + s)
                    waiting += 1
            if at:
                base = 4 * at - 4
                for s, cost in ARCS[kinds[at - 1]][state]:
                    if level + cost < dist[base + s]:
                        dist[base + s] = level + cost
                        queue[(level + cost) % (COSTLIEST + 1)].append(base + s)
                        waiting += 1
        if dist[START] <= level:  # all that a tight arc can reach from the start has been settled with this level
            break
        level += 1
    return dist


def solve(kinds: bytes) -> tuple[int, str]:
    """(cost, audit) of one conversation, given the kinds of its rows: the cheapest edits' initials, of equally cheap ones the ASCII-least."""
    dist, n = distances(kinds), len(kinds)
    at, state, audit = 0, START, bytearray()
    while at < n or state not in (START, ASSISTANT):
        left = dist[4 * at + state]
        kind = kinds[at] if at < n else None
        more = TRUNCATED if kind is not None and kind < FORCED and kind & CUT else 0
        if kind is not None and left == DELETE + dist[4 * at + 4 + state]:
            audit += b"D"
            at += 1
        elif left == INSERT + dist[4 * at + FILLED[state]]:
            audit += b"I"
            state = FILLED[state]
        elif kind is not None and kind < FORCED and (kept := KEPT[kind & 3][state]) is not None and left == KEEP + more + dist[4 * at + 4 + kept]:
            audit += b"K"
            at, state = at + 1, kept
        else:
            audit += b"R"
            at, state = at + 1, FILLED[state]
    return dist[START], audit.decode()


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by the CRC-32 of `conv_id:turn`; rows that it drops are gone."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    roll = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))), F.lit(20))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), roll.alias("roll"))
    text = F.when(F.col("roll") == 1, F.lit("")).when(F.col("roll") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("roll") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.where("roll <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("roll") == 3, 2).otherwise(1).alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) with digest, which stands for role and text."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))


def _kind(role: Column, text: Column) -> Column:
    initial = F.substring(role, 1, 1)
    left = F.rtrim(text, F.lit(WHITE))
    found = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    return F.when(left == "", found + 2 * CUT).when(~F.right(left, F.lit(1)).isin(".", "!", "?"), found + CUT).otherwise(found)


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    order = ["conv_id", *first, F.col("turn").asc_nulls_first(), "role", "digest"]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


class _Audit:
    """What is gathered of one conversation while its rows come by: kinds (a byte a row), counts of faults, turn numbers."""

    def __init__(self, conv: int | None):
        self.conv, self.kinds, self.initials = conv, [], []
        self.blank = self.duplicate = self.truncated = self.turns = 0
        self.low = self.high = None

    def take(self, turn: np.ndarray, has_turn: np.ndarray, kind: np.ndarray, later: np.ndarray, n: np.ndarray) -> None:
        known = turn[has_turn]
        if len(known):
            fresh = int((known[1:] != known[:-1]).sum()) + (self.high is None or int(known[0]) != self.high)
            self.turns += fresh
            self.low = int(known[0]) if self.low is None else self.low
            self.high = int(known[-1])
        copy = np.ones(int(n.sum()), bool)
        copy[np.cumsum(n) - n] = False
        kind, later = np.repeat(kind, n), np.repeat(later, n) | copy
        blank = kind >= 2 * CUT
        duplicate = ~blank & later
        self.initials.append((kind & 3).astype(np.uint8))
        self.kinds.append(np.where(blank | duplicate, FORCED, kind).astype(np.uint8))
        self.blank += int(blank.sum())
        self.duplicate += int(duplicate.sum())
        self.truncated += int((~blank & ~duplicate & (kind & CUT > 0)).sum())

    def row(self, solved: dict[bytes, tuple[int, str]]) -> tuple:
        kinds, initials = np.concatenate(self.kinds).tobytes(), np.concatenate(self.initials)
        # su, ua and au are the legal neighbours
        pairs = initials[:-1] * 4 + initials[1:]
        illegal = int((~np.isin(pairs, (1, 6, 9))).sum())
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        if (edits := solved.get(kinds)) is None:
            edits = solve(kinds)
            if len(kinds) <= SHORT and len(solved) < REMEMBERED:
                solved[kinds] = edits
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, illegal, *edits


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _segments(ids: pa.Array) -> Iterator[tuple[int | None, int, int]]:
    """(id, from, to) of the runs of equal ids in a column."""
    values = ids.to_pylist()
    start = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[start]:
            yield values[start], start, k
            start = k


def _audit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in AUDIT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    now: _Audit | None = None
    done: list[tuple] = []
    solved: dict[bytes, tuple[int, str]] = {}

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        turn = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        has_turn = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        kind, later, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
        for conv, a, b in _segments(batch.column(0)):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row(solved))
                now = _Audit(conv)
            now.take(turn[a:b], has_turn[a:b], kind[a:b], later[a:b], n[a:b])
        if len(done) >= BATCH_ROWS:
            yield made()
            done = []
    if now is not None:
        done.append(now.row(solved))
    if done:
        yield made()


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of rows (conv_id, turn, role, text, copies)."""
    narrow = _keyed(rows).select("conv_id", "turn", F.col("role"), "digest", _kind(F.col("role"), F.col("text")).alias("kind"), "copies")
    # the role itself only matters for the order of ties; equal rows are counted before the shuffle
    counted = stored(narrow.groupBy("conv_id", "turn", "role", "digest", "kind").agg(F.sum("copies").alias("n")), "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = counted.groupBy(F.col("conv_id").alias("f_conv"), F.col("digest").alias("f_digest")).agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    firsts = stored(firsts.select("f_conv", "f_digest", F.col("first.turn").alias("first_turn")), "repair-firsts")
    same = counted.conv_id.eqNullSafe(firsts.f_conv) & (counted.digest == firsts.f_digest)
    later = F.col("f_digest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    marked = _ordered(counted.join(firsts, same, "left").select("conv_id", "turn", "role", "digest", "kind", later.alias("later"), "n"))
    return marked.select("conv_id", "turn", "kind", "later", "n").mapInArrow(_audit_rows, AUDIT)


REPAIRED = "conv_id long, place long, role string, text string, edit string"


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies each conversation's audit, which comes before its rows, to the rows that follow."""
    conv, audit, at, state, place = None, "", 0, START, 0
    out: list[tuple] = []

    def filled() -> None:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            out.append((conv, place, FILLED_ROLE[state], "", "I"))
            at, state, place = at + 1, FILLED[state], place + 1

    def made() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "role", "text", "edit"])

    for batch in batches:
        for part in runs([batch], BATCH_BYTES):
            for given, is_row, role, text in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                if not is_row:
                    filled()
                    conv, audit, at, state, place = given, text, 0, START, 0
                    continue
                filled()
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "R":
                    role, state = FILLED_ROLE[state], FILLED[state]
                else:
                    state = KEPT["sua".index(role[0])][state]
                out.append((conv, place, role, text, edit))
                place += 1
            if out:
                yield made()
                out.clear()
    filled()
    if out:
        yield made()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of the repaired conversations: found are the audits of rows (conv_id, turn, role, text, copies). The rows of a
    conversation stand in one partition, by place."""
    columns = ["conv_id", "is_row", "turn", "role", "digest", "text"]
    keyed = _keyed(rows).withColumn("is_row", F.explode(F.array_repeat(F.lit(True), F.col("copies")))).select(*columns)
    none = lambda c: F.lit(None).cast(keyed.schema[c].dataType).alias(c)
    heads = found.select("conv_id", F.lit(False).alias("is_row"), none("turn"), none("role"), none("digest"), F.col("audit").alias("text"))
    dealt = _ordered(heads.union(keyed), "is_row")
    return dealt.select("conv_id", "is_row", "role", "text").mapInArrow(_repaired_rows, REPAIRED)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, sha = None, None
    done: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.string()), strict=True)], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        for given, place, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            line = f"{role}:{text}".encode()
            if place == 0:
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                conv, sha = given, hashlib.sha256(line)
            else:
                sha.update(b"\n")
                sha.update(line)
        if len(done) >= BATCH_ROWS:
            yield made()
            done = []
    if sha is not None:
        done.append((conv, sha.hexdigest()))
    if done:
        yield made()


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows, in the partitions that `repaired` gives: the SHA-256 of `role:text` joined by newlines."""
    return rows.select("conv_id", "place", "role", "text").mapInArrow(_digest_rows, "conv_id long, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = damaged(turns)
    found = stored(audits(rows), "audits")
    hashed = stored(digests(repaired(rows, found)), "repaired-digests")
    every = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.count("*").alias("rows"))
    a, h = found.withColumnRenamed("conv_id", "a_conv"), hashed.withColumnRenamed("conv_id", "h_conv")
    joined = every.join(a, every.conv_id.eqNullSafe(a.a_conv), "left").join(h, every.conv_id.eqNullSafe(h.h_conv), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    whole = (F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counts)
    return joined.select("conv_id", *whole, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
