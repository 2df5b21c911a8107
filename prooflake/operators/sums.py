"""Sums of vectors over all rows, for fits whose parameters are few: every task adds up its own, and few sums reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Sums of each model that the driver gets, however many tasks there are.
SLICES = 8
_SCHEMA = "model int, slice int, sums binary"


def _rows(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(sums)
    columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["model", "slice", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for model, slice_, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            key = model, slice_
            total[key] = total.get(key, 0.0) + np.frombuffer(raw)
    if total:
        yield _rows(total)


def summed(rows: DataFrame, measure: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sum over all batches of the vectors (doubles) that measure gives for each model, in one pass over rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for model, vector in measure(batch).items():
                    own[model] = own.get(model, 0.0) + vector
        if own:
            part = TaskContext.get().partitionId() % SLICES
            yield _rows({(model, part): vector for model, vector in own.items()})

    found: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(work, _SCHEMA).repartition(SLICES, "slice").mapInArrow(_added, _SCHEMA).collect():
        found[r.model] = found.get(r.model, 0.0) + np.frombuffer(r.sums)
    return found
