"""Pairs and measures of the units of a key, however many it has: a row each, never an array of them, and several tasks for a large key.

A key's units are dealt to blocks by hash, as many as its bytes need. Each block is a group: its units meet each other there, and then the units
of half of the other blocks, which go through the task as a stream, so every two blocks meet once. A task holds a block and a run of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from prooflake.operators.similarity import Index, _Sets, _sets

#: Bytes of text in a block of units, and of words of other blocks that a task takes at once.
BLOCK_BYTES, RUN_BYTES = 16 << 20, 4 << 20
#: What a row of a group is, in order: what is asked of the key, a unit of the block, a unit of another block.
_ASKED, _OWN, _OTHER = range(3)


def dealt(units: DataFrame, sizes: DataFrame, keys: DataFrame, partitions: int) -> DataFrame:
    """The groups' rows. units: key, uid (ascending in a key's order, null: not numbered), only (the one state that has it, null: all) and words (similarity.coded);
    sizes: key and bytes of a key's texts; keys: key, asked (array of different words) and gone (the uid of a unit that one state lacks). Units of other keys go."""
    many = sizes.select(F.col("key").alias("_key"), F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("_blocks")).where("_blocks > 1")
    several = lambda rows: rows.join(F.broadcast(many), F.col("key") == F.col("_key"), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).drop("_key")  # noqa: E731 (a row for each BLOCK_BYTES of text at most)
    own = F.pmod(F.xxhash64("uid", "only"), F.col("_blocks")).cast("int")
    # block b goes to the groups b, b - 1, ...: half way round, and where the number is even only one of two opposite blocks goes to the other
    at = F.filter(F.sequence(F.lit(0), F.floor(F.col("_blocks") / 2).cast("int")), lambda k: (k == 0) | (2 * k < F.col("_blocks")) | (F.col("_b") >= k))
    role = lambda k: F.when(k == 0, _OWN).otherwise(_OTHER)
    placed = several(units).withColumn("_b", own).withColumn("_k", F.explode(at)).select(
        "key", F.pmod(F.col("_b") - F.col("_k"), F.col("_blocks")).alias("block"), role(F.col("_k")).alias("role"), "uid", "only", "words", F.lit(None).cast("array<string>").alias("asked"), F.lit(None).cast("long").alias("gone"),
    )
    none = {name: F.lit(None).cast(placed.schema[name].dataType).alias(name) for name in ("uid", "only", "words")}
    told = several(keys).select("key", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"), F.lit(_ASKED).alias("role"), *none.values(), "asked", "gone")
    # a number of its own: adaptive execution would put many small groups into few tasks, and groups take long
    return placed.unionByName(told).repartition(partitions, "key", "block").sortWithinPartitions("key", "block", "role")


class _Units(NamedTuple):
    """Some units of a group. masks: the states that each is in, as bits."""

    uid: pa.Array
    masks: np.ndarray
    sets: _Sets


class _Group:
    """The rows of one key and block, in order of role."""

    def __init__(self, asked: pa.RecordBatch, states: int, gone_from: int) -> None:
        self.key, self.asked, self.gone, self.kinds = asked.column(0), asked.column(6), asked.column(7)[0].as_py(), asked.schema.types
        self.states, self.gone_from = states, gone_from
        self.held: list[pa.RecordBatch] = []
        self.bytes = 0
        self.units: _Units | None = None
        self.index: Index | None = None

    def take(self, rows: pa.RecordBatch) -> None:
        self.held.append(rows)
        self.bytes += rows.nbytes

    def held_units(self) -> _Units:
        """What was taken since the last call."""
        uid, only, words = (pa.concat_arrays([pa.array([], self.kinds[k]), *(b.column(k) for b in self.held)]) for k in (3, 4, 5))
        only = np.asarray(only.fill_null(-1)).astype(np.int64)
        masks = np.where(only < 0, (1 << self.states) - 1, 1 << np.maximum(only, 0))
        if self.gone is not None:
            masks = np.where(np.asarray(pc.fill_null(pc.equal(uid, self.gone), False)) & (only < 0), masks & ~(1 << self.gone_from), masks)
        found = _Units(uid, masks, _sets(words))
        self.held, self.bytes = [], 0
        return found

    def own(self, threshold: float) -> Iterator[tuple[_Units, np.ndarray, _Units, np.ndarray, np.ndarray]]:
        """The block's own pairs; then no more units of it may come."""
        self.units = u = self.held_units()
        self.index = u.sets.index()
        for i, j, ratio in self.index.own(threshold):
            yield u, i, u, j, ratio

    def others(self, threshold: float) -> Iterator[tuple[_Units, np.ndarray, _Units, np.ndarray, np.ndarray]]:
        u = self.held_units()
        for i, j, ratio in u.sets.met_by(self.index, self.units.sets, threshold):
            yield u, i, self.units, j, ratio


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """((key, block), role, rows) of rows that stand together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in range(3):
            codes = np.asarray(batch.column(k).dictionary_encode(null_encoding="encode").indices)
            new[1:] |= codes[1:] != codes[:-1]
        at = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield (batch.column(0)[a].as_py(), batch.column(1)[a].as_py()), batch.column(2)[a].as_py(), batch.slice(a, b - a)


def _groups(batches: Iterator[pa.RecordBatch], threshold: float, states: int, gone_from: int) -> Iterator[tuple[_Group, Iterator]]:
    """Of each group again and again (group, some of its pairs), the group's own units first; at its end (group, None)."""
    group, name = None, None
    for now, role, rows in _runs(batches):
        if now != name:
            if group is not None:
                yield from _ended(group, threshold)
            group, name = None, now
        if role == _ASKED:
            group = _Group(rows, states, gone_from)
        elif group is not None:  # else the key isn't asked for
            if role == _OTHER and group.units is None:
                yield group, group.own(threshold)
            group.take(rows)
            if role == _OTHER and group.bytes >= RUN_BYTES:
                yield group, group.others(threshold)
    if group is not None:
        yield from _ended(group, threshold)


def _ended(group: _Group, threshold: float) -> Iterator[tuple[_Group, Iterator]]:
    if group.units is None:
        yield group, group.own(threshold)
    elif group.held:
        yield group, group.others(threshold)
    yield group, None


def measured(rows: DataFrame, threshold: float, states: int = 1, gone_from: int = 0) -> DataFrame:
    """Of dealt() rows (key, state, n, total, least, similar, met), some rows for a key and state, which together() adds up: as similarity.measured says, met
    as places in `asked`. gone_from: the state without the unit `gone`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        similar = np.zeros(states, np.int64)
        for group, pairs in _groups(batches, threshold, states, gone_from):
            if pairs is not None:
                for left, i, right, j, _ in pairs:
                    both = left.masks[i] & right.masks[j]
                    similar += np.array([np.count_nonzero(both >> s & 1) for s in range(states)], np.int64)
                continue
            sets, masks = group.units.sets, group.units.masks
            place = sets.places(group.asked.flatten())[sets.tokens]
            row, place = sets.of[place >= 0], place[place >= 0]
            out = []
            for s in range(states):
                inside = (masks >> s & 1).astype(bool)
                filled = sets.lengths[inside & (sets.lengths > 0)]
                met = np.unique(place[inside[row]]).tolist()
                out.append((s, len(filled), int(filled.sum()), int(filled.min()) if len(filled) else None, int(similar[s]), met))
            keys = group.key.take(pa.array([0] * states))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), _MEASURED.values(), strict=True))], names=["key", *_MEASURED])
            similar = np.zeros(states, np.int64)

    return rows.mapInArrow(work, f"key {rows.schema['key'].dataType.simpleString()}, state int, n long, total long, least int, similar long, met array<int>")


_MEASURED = {"state": pa.int32(), "n": pa.int64(), "total": pa.int64(), "least": pa.int32(), "similar": pa.int64(), "met": pa.list_(pa.int32())}


def together() -> dict[str, Column]:
    """Aggregations of measured() rows."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return {"n": zero("n"), "total": zero("total"), "least": F.coalesce(F.min("least"), F.lit(0)), "similar": zero("similar"), "met": F.size(F.array_distinct(F.flatten(F.collect_list("met"))))}


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Of dealt() rows (key, i, j, similarity) of the pairs over the threshold, by their uids, i < j; they leave a task block by block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, pairs in _groups(batches, threshold, 1, 0):
            for left, i, right, j, ratio in pairs or ():
                if len(i):
                    p, q = (np.asarray(u.uid)[k].astype(np.int32) for u, k in ((left, i), (right, j)))
                    key = group.key.take(pa.array(np.zeros(len(p), np.int64)))
                    yield pa.RecordBatch.from_arrays([key, pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(ratio)], names=["key", "i", "j", "similarity"])

    kinds = (("i", IntegerType()), ("j", IntegerType()), ("similarity", DoubleType()))
    return rows.mapInArrow(work, StructType([StructField("key", rows.schema["key"].dataType), *(StructField(name, kind) for name, kind in kinds)]))
