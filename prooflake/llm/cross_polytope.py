"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform rotate a unit vector; the nearest signed axis of the rotation is its cell.
Each table concatenates two such cells: the coarse one deals vectors to tasks, the fine one sorts them inside. A vector is indexed once in
each table. A query probes every cell pair whose gap, the squared distances by which its axes are farther than the query's own nearest
axes, is at most a threshold: it is sent to the coarse cells that can hold such pairs, and there meets the vectors of the fine cells that
do. What it meets is ranked by exact Euclidean distance on the original vectors. A query that met fewer than k vectors probes
every cell of the first table, so it gets k neighbours whenever the table holds as many.

The number of tables and the threshold are fitted (`fit`): the true neighbours of FIT_QUERIES queries, by brute force over ALL rows (one
narrow pass), tell how large a gap each of them needs; for each number of tables the threshold is the gap that reaches TARGET of
them, a sample of FIT_ROWS rows tells the share of candidates, and the cheapest pair is taken. So recall is measured on the rows
themselves, whatever their lengths or structure, and with more rows, whose neighbours are nearer, fewer cells are probed.

Cells are split into parts of CELL_ROWS vectors and QUERY_ROWS queries, so no task holds a whole hot cell; every row is indexed.
Rows: vectors that are null, zero, of another dimension than most rows (ties: the smallest), or that hold null or non-finite
components take no part, nor do rows with a null id. Components of any finite size are compared (a distance beyond double precision is
infinite and comes last). A repeated id counts once, at its smallest distance. No query has itself as neighbour. An empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prooflake.llm.common import stored, table

#: Numbers of tables that are tried, the share of true neighbours that must be met, and the bounds of what is fitted on.
TABLES, TARGET, FIT_QUERIES, FIT_ROWS, SEED = (4, 8, 16), 0.97, 100, 4000, 42
#: Components that the sample of rows may have in all, so that the driver holds few rows of very long vectors.
FIT_VALUES = 1 << 20
#: Cost of indexing a row in one table, in candidates that a query could look at instead.
TABLE_COST = 100
CELL_ROWS, QUERY_ROWS, FOUND_ROWS = 4096, 1024, 1 << 18


class Settings(NamedTuple):
    tables: int
    gap: float
    recall: float
    candidates: float  # share of all rows that a query meets


EVERY = Settings(1, float("inf"), 1.0, 1.0)


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """One pseudo-rotation: H D3 H D2 H D1 on rows padded with zeros to a power of two."""
    n, dim = x.shape
    size = 1 << max(0, dim - 1).bit_length()
    y = np.zeros((n, size))
    y[:, :dim] = x
    signs = np.random.default_rng([SEED, number]).choice([-1.0, 1.0], (3, size))
    for round_no in range(3):
        y = y * signs[round_no]
        half = 1
        while half < size:
            pair = y.reshape(n, -1, 2, half)
            y = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(n, size)
            half *= 2
        y = y / np.sqrt(size)
    return y


def gaps(rotated: np.ndarray) -> np.ndarray:
    """rows x cells: by how much each signed axis (2 * axis, + 1 if negative) is farther than the nearest one, squared."""
    toward = np.stack([rotated, -rotated], 2).reshape(len(rotated), -1)
    return (toward.max(1, keepdims=True) - toward) ** 2


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def distances(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Euclidean, scaled first where squares leave the range of doubles."""
    with np.errstate(all="ignore"):
        gap = rows - own
        found = np.sqrt((gap * gap).sum(1))
        odd = np.flatnonzero(~np.isfinite(found) | (found < 1e-140))
        if len(odd):
            largest = np.abs(gap[odd]).max(1)
            fine = (largest > 0) & np.isfinite(largest)
            inside = gap[odd][fine] / largest[fine][:, None]
            found[odd] = largest
            found[odd[fine]] = largest[fine] * np.sqrt((inside * inside).sum(1))
    return found


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part; floats stay floats, all else becomes doubles."""
    vec = F.col(vector_col)
    fine = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0) & F.col(id_col).isNotNull()
    kind = vectors.schema[vector_col].dataType.simpleString()
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), vec.cast(kind if kind == "array<float>" else "array<double>").alias("vec"))
    most = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("vec") == (most["dim"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _kind(rows: DataFrame) -> str:
    return "<f4" if rows.schema["vec"].dataType.simpleString() == "array<float>" else "<f8"


def _top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores of each query, each vector once, ties to the smaller id."""
    if not len(query):
        return np.zeros(0, np.int64)
    order = np.lexsort((score, vec, query))
    new = np.concatenate([[True], (query[order][1:] != query[order][:-1]) | (vec[order][1:] != vec[order][:-1])])
    order = order[new]  # the smallest score of each pair
    order = order[np.lexsort((vec[order], score[order], query[order]))]
    heads = np.flatnonzero(np.concatenate([[True], query[order][1:] != query[order][:-1]]))
    place = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order[place < k]


def best(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in v, distance) of the k nearest ids of each query among those met (queries x rows; all if None), each at its
    smallest distance. Rows of v come sorted by id. A quick form only narrows the rows down; distances are exact."""
    size = max(float(np.abs(q).max()), float(np.abs(v).max()))
    scale = 1.0 if 1e-100 < size < 1e100 else 1.0 / size if 1.0 / size < float("inf") else 1e308
    qs, vs = (q, v) if scale == 1.0 else (q * scale, v * scale)
    vv, qq = (vs * vs).sum(1), (qs * qs).sum(1)
    if met is not None and len(v) > 64 and met.mean() < 0.25:  # few of the pairs: only rows that some query met
        some = np.flatnonzero(met.any(0))
        v_ids, v, vs, vv, met, back = v_ids[some], v[some], vs[some], vv[some], met[:, some], some
    else:
        back = np.arange(len(v))
    quick = vv[None] + qq[:, None] - 2 * (qs @ vs.T)
    quick[q_ids[:, None] == v_ids[None]] = np.inf
    if met is not None:
        quick[~met] = np.inf
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not len(v_ids):
        return out[0]
    slack = 1e-9 * (vv.max() + qq.max()) + 1e-300
    starts = np.flatnonzero(np.append(True, v_ids[1:] != v_ids[:-1]))
    least = np.minimum.reduceat(quick, starts, axis=1) if len(starts) < len(v_ids) else quick
    bounds = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] > k else np.full(len(q), np.inf)
    for row, bound, own, query in zip(quick, bounds, q, q_ids, strict=True):
        near = np.flatnonzero((row <= bound + slack) & np.isfinite(row))
        if len(near):
            distance = distances(v[near], own)
            kept = _top(np.zeros(len(near), np.int64), v_ids[near], distance, k)
            out.append((np.full(len(kept), query), back[near[kept]], distance[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def true_neighbours(queries: tuple[np.ndarray, np.ndarray], rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, vec) of the k nearest rows of a few queries (ids, vectors), by brute force in one narrow pass."""
    kind, sent = _kind(rows), rows.sparkSession.sparkContext.broadcast((queries[0].tolist(), queries[1].tolist()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = np.array(sent.value[0], np.int64), np.array(sent.value[1])
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, raw = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            order = np.argsort(ids, kind="stable")
            ids, raw = ids[order], raw[order]
            for at in range(0, len(ids), CELL_ROWS):
                query, place, score = best(q_ids, q, ids[at : at + CELL_ROWS], raw[at : at + CELL_ROWS].astype(np.float64), k)
                new = [query, ids[at:][place], score, raw[at:][place]]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
                held = [x[_top(*held[:3], k)] for x in held]
        if held is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in held[:3]), pa.array([v.astype(kind).tobytes() for v in held[3]], pa.binary())], names=["query_id", "vec_id", "score", "vec"])

    found = rows.mapInArrow(work, "query_id long, vec_id long, score double, vec binary")
    one = found.groupBy("query_id", "vec_id").agg(F.min(F.struct("score", "vec")).alias("x"))
    order = Window.partitionBy("query_id").orderBy("x.score", "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "x.score", "x.vec")


def needed_gaps(q: np.ndarray, v: np.ndarray, tables: int) -> np.ndarray:
    """pairs x tables: the gap at which query q[i] meets v[i]."""
    a, b = unit(q), unit(v)
    out = []
    for t in range(tables):
        need = np.zeros(len(a))
        for number in (2 * t, 2 * t + 1):
            need += np.take_along_axis(gaps(rotate(a, number)), gaps(rotate(b, number)).argmin(1)[:, None], 1)[:, 0]
        out.append(need)
    return np.stack(out, 1)


def fit(queries: DataFrame, rows: DataFrame, k: int) -> Settings:
    """The cheapest settings that meet TARGET of the true neighbours. What reaches the driver is bounded by FIT_QUERIES and FIT_ROWS."""
    drawn = lambda df, n: df.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(n).collect()
    kind, asked = _kind(rows), {r.id: r.vec for r in drawn(queries, FIT_QUERIES)}
    if not asked:
        return EVERY
    ids, q = np.array(list(asked), np.int64), np.array(list(asked.values()))
    pairs = true_neighbours((ids, q), rows, k).collect()
    if not pairs:
        return EVERY
    place = {i: at for at, i in enumerate(ids.tolist())}
    own = np.array([place[p.query_id] for p in pairs])
    need = needed_gaps(q[own], np.stack([np.frombuffer(p.vec, kind) for p in pairs]).astype(np.float64), TABLES[-1])
    sample = np.array([r.vec for r in drawn(rows, max(1, min(FIT_ROWS, FIT_VALUES // q.shape[1])))])
    some = np.random.default_rng(SEED).integers(0, len(sample), (len(q), min(40, len(sample))))
    met = needed_gaps(np.repeat(q, some.shape[1], axis=0), sample[some.ravel()], TABLES[-1])
    n, found = queries.count(), []
    for tables in TABLES:
        each = np.sort(need[:, :tables].min(1))
        gap = float(each[min(len(each) - 1, int(np.ceil(TARGET * len(each))))]) * (1 + 1e-9)
        share = float((met[:, :tables].min(1) <= gap).mean())
        found.append((tables * TABLE_COST + share * n, Settings(tables, gap, float((each <= gap).mean()), share)))
    return min(found)[1]


def _indexed(rows: DataFrame, tables: int) -> DataFrame:
    """(tab, cell, fine, id, vec binary) of each row in each table."""
    kind = _kind(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                u, raw = unit(x.astype(np.float64)), pa.array([v.astype(kind).tobytes() for v in x], pa.binary())
                for t in range(tables):
                    cell, fine = (pa.array(gaps(rotate(u, number)).argmin(1).astype(np.int32)) for number in (2 * t, 2 * t + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), cell, fine, batch.column(0), raw], names=["tab", "cell", "fine", "id", "vec"])

    return rows.mapInArrow(work, "tab int, cell int, fine int, id long, vec binary")


def _asked(queries: DataFrame, tables: int, gap: float) -> DataFrame:
    """(tab, cell, fine, id, vec binary) of each query in each coarse cell that may hold cells within the gap; fine is -1."""
    kind = _kind(queries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                u, raw = unit(x.astype(np.float64)), pa.array([v.astype(kind).tobytes() for v in x], pa.binary())
                for t in range(tables):
                    row, cell = np.nonzero(gaps(rotate(u, 2 * t)) <= gap)
                    n = len(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, t, np.int32)), pa.array(cell.astype(np.int32)), pa.array(np.full(n, -1, np.int32)), batch.column(0).take(pa.array(row)), raw.take(pa.array(row))],
                        names=["tab", "cell", "fine", "id", "vec"],
                    )

    return queries.mapInArrow(work, "tab int, cell int, fine int, id long, vec binary")


def _ranked(batches: Iterator[pa.RecordBatch], k: int, gap: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows (part, tab, cell, fine, id, vec) come sorted by part, queries (fine -1) first, then by id; a part is at most CELL_ROWS vectors
    and QUERY_ROWS queries, within chance."""
    found: list[np.ndarray] | None = None

    def packed(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["query_id", "vec_id", "score"])

    def flush(parts: list[pa.RecordBatch]) -> list[np.ndarray] | None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        fine = rows.column("fine").to_numpy()
        cut = int((fine < 0).sum())
        if not 0 < cut < len(fine):
            return None
        tab, cell = rows.column("tab")[0].as_py(), rows.column("cell")[0].as_py()
        ids = rows.column("id").to_numpy()
        vec = np.frombuffer(b"".join(rows.column("vec").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)
        v_ids, v, out = ids[cut:], vec[cut:], []
        for at in range(0, cut, QUERY_ROWS):
            q_ids, q = ids[at : min(cut, at + QUERY_ROWS)], vec[at : min(cut, at + QUERY_ROWS)]
            u = unit(q)
            left = gap - gaps(rotate(u, 2 * tab))[:, cell]
            met = (gaps(rotate(u, 2 * tab + 1)) <= left[:, None])[:, fine[cut:]]
            query, place, score = best(q_ids, q, v_ids, v, k, met)
            out.append([query, v_ids[place], score])
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        group = batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b <= a:
                continue
            if held and held[-1].column("part")[0].as_py() != group[a]:
                if (new := flush(held)) is not None:
                    found = new if found is None else [np.concatenate(x) for x in zip(found, new, strict=True)]
                held = []
                if found is not None and len(found[0]) > FOUND_ROWS:
                    kept = _top(*found, k)
                    if len(kept) > FOUND_ROWS // 2:
                        yield packed([x[kept] for x in found])
                        found = None
                    else:
                        found = [x[kept] for x in found]
            held.append(batch.slice(a, b - a))
    if held and (new := flush(held)) is not None:
        found = new if found is None else [np.concatenate(x) for x in zip(found, new, strict=True)]
    if found is not None and len(found[0]):
        yield packed([x[_top(*found, k)] for x in found])


def _meet(queries: DataFrame, rows: DataFrame, settings: Settings, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each query's candidates, each pair once."""
    spark, kind = rows.sparkSession, _kind(rows)
    indexed, asked = _indexed(rows, settings.tables), _asked(queries, settings.tables, settings.gap)
    # at most 2 * dimension * tables rows reach the driver
    n_rows = {(r.tab, r.cell): r["count"] for r in indexed.groupBy("tab", "cell").count().collect()}
    n_asked = {(r.tab, r.cell): r["count"] for r in asked.groupBy("tab", "cell").count().collect()}
    sizes = [(t, c, -(-n // CELL_ROWS), -(-n_asked[t, c] // QUERY_ROWS)) for (t, c), n in n_rows.items() if (t, c) in n_asked]
    parts = F.broadcast(spark.createDataFrame(sizes, "tab int, cell int, v_parts int, q_parts int"))

    def part(own: Column, others: Column, first: bool) -> Column:
        # a row joins one part of its own side and all parts of the other side
        pairs = F.transform(F.sequence(F.lit(0), others - 1), lambda o: F.struct((own if first else o).alias("v"), (o if first else own).alias("q")))
        return F.explode(pairs)

    v = indexed.join(parts, ["tab", "cell"]).withColumn("at", part(F.pmod(F.xxhash64("id"), F.col("v_parts")).cast("int"), F.col("q_parts"), True))
    q = asked.join(parts, ["tab", "cell"]).withColumn("at", part(F.pmod(F.xxhash64("id"), F.col("q_parts")).cast("int"), F.col("v_parts"), False))
    shape = lambda df: df.select(F.xxhash64("tab", "cell", "at.v", "at.q").alias("part"), "tab", "cell", "fine", "id", "vec")
    dealt = shape(q).union(shape(v)).repartition("part").sortWithinPartitions("part", F.col("fine") >= 0, "id")
    found = dealt.mapInArrow(lambda batches: _ranked(batches, k, settings.gap, kind), "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and rows with id and vec (floats or doubles)."""
    settings = settings or fit(queries, rows, k)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = stored(top(_meet(queries, rows, settings, k)), "neighbours")
    full = first.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = stored(queries.join(full, "id", "left_anti"), "short-queries")
    if not short.isEmpty():
        every = top(_meet(short, rows, EVERY, k))
        first = first.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(every)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return nearest(rows.where("id % 100 = 0"), rows)
