"""JSON arrays of objects, one array a file, read by byte ranges and written by all tasks.

A range can't know whether it starts inside a string, and how deep in brackets. So it is scanned for both cases first: how often its quotes
switch between inside and outside, and what its brackets outside strings add to the depth. These few numbers a range, added up in order of
the ranges, give the state in which each starts. In a second scan each range cuts its records out; a record that lies across ranges comes in
pieces, which are put together by its number.

Ranges are Spark's own splits of a text file whose line ends are opening braces: cut at an ASCII character, they hold whole UTF-8 characters,
and no escape sequence lies across two of them. What the driver keeps is a row a split, of which it plans as many anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prooflake.storage import SMALL_BATCHES, set_for_a_while, stored

#: Text that is scanned at once (its places are 64-bit numbers, so a scan takes some thirty times as much), and of records that leave a task together.
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
_OPEN = b"{"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """((file, start of the split), text) of runs of rows; every row is followed by the brace that ended it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * BLOCK_BYTES / max(batch.nbytes, BLOCK_BYTES)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            values, files, starts = part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()
            first = 0
            for k in range(1, len(values) + 1):
                if k == len(values) or (files[k], starts[k]) != (files[first], starts[first]):
                    yield (files[first], starts[first]), _OPEN.join(values[first:k]) + _OPEN
                    first = k


def _scan(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places of brackets, +1 or -1 for each, whether it is inside a string if the block starts outside, number of quotes)."""
    text = np.frombuffer(block, np.uint8)
    quotes = np.flatnonzero(text == 34)
    slashes = text == 92
    if len(quotes) and slashes.any():
        # a quote behind an odd number of backslashes is escaped
        other = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(text))))
        before = np.where(quotes > 0, other[np.maximum(quotes - 1, 0)], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    at = np.flatnonzero((text == 123) | (text == 125) | (text == 91) | (text == 93))
    step = np.where((text[at] == 123) | (text[at] == 91), 1, -1)
    return at, step, np.searchsorted(quotes, at) % 2 == 1, len(quotes)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list[int]] = {}
    for split, block in _blocks(batches):
        _, step, inside, n = _scan(block)
        flips, out, in_ = found.get(split, (0, 0, 0))
        a, b = int(step[~inside].sum()), int(step[inside].sum())  # outside and inside, if the block starts outside
        if flips:
            a, b = b, a
        found[split] = [(flips + n) % 2, out + a, in_ + b]
    if found:
        columns = [[f for f, _ in found], [s for _, s in found], *zip(*found.values(), strict=True)]
        kinds = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "start", "flips", "outside", "inside"])


def _records(states: dict[tuple[str, int], tuple[bool, int]]):
    """Cuts the records out of ranges whose states at the start (inside a string, depth) are known."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside_now, depth, k, waiting = None, False, 0, 0, 0
        part, opened, out = [], False, []  # the text of a record that is open, and whether it was opened in this split

        def made() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            names = ["file", "start", "k", "text", "opens", "closes"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        def piece(closes: bool) -> None:
            nonlocal k, part, waiting
            text = b"".join(part)
            waiting += len(text)
            out.append((*now, k if opened else -1, text.decode("utf-8", "replace"), opened, closes))
            k += opened
            part = []

        for split, block in _blocks(batches):
            if split != now:
                if now is not None and depth >= 2:
                    piece(False)
                now, (inside_now, depth), k, opened = split, states[split], 0, False
            at, step, inside, n = _scan(block)
            real = inside == inside_now
            at, step = at[real], step[real]
            after = depth + np.cumsum(step)
            starts, ends = at[(after == 2) & (step == 1)], at[(after == 1) & (step == -1)]
            from_ = 0 if depth >= 2 else None
            i = j = 0
            while True:
                if from_ is None:
                    if i == len(starts):
                        break
                    from_, opened, i = int(starts[i]), True, i + 1
                if j == len(ends):
                    part.append(block[from_:])
                    break
                to, j = int(ends[j]) + 1, j + 1
                part.append(block[from_:to])
                piece(True)
                from_, opened = None, False
            inside_now ^= n % 2 == 1
            depth = int(after[-1]) if len(after) else depth
            if waiting >= BATCH_BYTES or len(out) >= 1000:
                yield made()
                out.clear()
                waiting = 0
        if now is not None and depth >= 2:
            piece(False)
        if out:
            yield made()

    return work


def read(spark: SparkSession, path: str, schema: str, ordinal: str | None = None) -> DataFrame:
    """The objects of the arrays at path in the given schema; `ordinal` names a column for their number from 0 in their file, if wanted.

    What doesn't parse, a record that never ends and an array as an element are errors. Strings, numbers and nulls as elements are left out; an
    empty array gives no rows.
    """
    rows = spark.read.option("lineSep", "{").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    splits = stored(rows.mapInArrow(_summaries, "file string, start long, flips long, outside long, inside long"), "json-splits")
    begun = splits.withColumn("quoted", F.coalesce(F.sum("flips").over(order), zero) % 2 == 1)
    begun = begun.withColumn("depth", F.coalesce(F.sum(F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside"))).over(order), zero))
    states = {(r.file, r.start): (r.quoted, r.depth) for r in begun.toLocalIterator()}
    pieces = stored(rows.mapInArrow(_records(states), "file string, start long, k long, text string, opens boolean, closes boolean"), "json-pieces")
    opened = pieces.groupBy("file", "start").agg(F.count_if("opens").alias("n"))
    bases = opened.select(F.col("file").alias("b_file"), F.col("start").alias("b_start"), F.coalesce(F.sum("n").over(order), zero).alias("base"))
    placed = pieces.join(bases, (F.col("file") == F.col("b_file")) & (F.col("start") == F.col("b_start")))
    # a piece that doesn't open a record belongs to the last one opened before its range
    placed = placed.select("file", (F.col("base") + F.col("k")).alias("number"), "start", "text", "opens", "closes")
    whole = placed.where("opens AND closes").select("number", "text")
    parts = placed.where("NOT (opens AND closes)").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"), F.bool_or("closes").alias("closed"))
    text = F.when(F.col("closed"), F.array_join(F.transform("p", lambda x: x["text"]), "")).otherwise(F.raise_error(F.lit("a record of a JSON array doesn't end")).cast("string"))
    both = whole.union(parts.select("number", text))
    found = both.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r"), "number")
    return found.select("r.*", *([F.col("number").alias(ordinal)] if ordinal else []))


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    yield pa.RecordBatch.from_arrays([pa.array(["["])], names=["value"])
    for batch in batches:
        if batch.num_rows:
            lines = [("" if first and k == 0 else ",") + x for k, x in enumerate(batch.column(0).to_pylist())]
            first = False
            yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])


def write(rows: DataFrame, path: str) -> None:
    """rows as JSON arrays, a file for each partition, with nulls kept; a line a record."""
    lines = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    with set_for_a_while(rows.sparkSession, SMALL_BATCHES):  # else a task's Python holds 10,000 records, several times
        lines.mapInArrow(_as_array, "value string").write.mode("overwrite").text(path)
