"""Removal of repeated byte passages by suffix arrays of shards, merged across shards by binary search.

Every LENGTH-byte window that also starts earlier (in an earlier document, or earlier in the same one) has all its bytes
removed. Each window is represented by its anchor: the K-byte substring of smallest hash. Equal windows have equal anchors at
equal places, so an anchor whose hash occurs once in the corpus rules its windows out; this only narrows the text that the
suffix arrays see. The steps:

1. of equal texts the first stays; what stays is stored in batches of about BATCH_BYTES. Of each batch the sorted hashes of its anchors, with counts, are cut by binary search
   into ranges, one an owner. An owner adds the counts up and replies to each batch which of its anchors repeat, and which do so
   more than FREQUENT times;
2. the stretches of a batch whose windows have repeated anchors form shards of SHARD_BYTES. A shard's suffix array comes from
   Larsson-Sadakane refinement (sort by eight bytes, then double the depth within groups that still tie), its common prefixes from
   Kasai's bounds; of the windows with a common prefix of LENGTH the first stays and the others go;
3. windows that stay are merged across shards. Neighbouring ones with one anchor travel as a run to the anchor's owner, which merges the
   shards' sorted runs, then the sorted windows of runs that differ but share an anchor, by binary search of one shard's array in the
   other's, two and two; equal hashes are compared by bytes. Windows of frequent anchors go by 128-bit hashes of their own: each task first
   joins those of its shards, and what stays is cut into the owners' ranges of hashes. So what must come together is at most FREQUENT
   runs of an anchor, or one window's copies, of which a task sends one;
   Owners are at most MOST_OWNERS and batches grow with the corpus, so what a batch or shard sends is a bounded number of rows at any size.
   An owner with more than OWNER_BYTES to answer for cuts its range into parts, sorts them (Spark's sort spills) and takes one at a time;
4. the byte ranges of all steps are joined to the texts and cut out.

Rows: a null text counts as empty; texts under LENGTH bytes stay whole. Equal texts are compared once: all but the first (by
doc_id, nulls last, then reading order) are removed whole. Rows with equal ids are separate documents in reading order. An empty
table gives an empty result; other columns are ignored, or carried along in one struct. Texts of any length are used whole; longer
ones than PIECE_BYTES are worked on in pieces that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prooflake.llm.common import release, runs, stored, table, texts_of, used_up

LENGTH, K = 100, 32
SPAN = LENGTH - K + 1
#: Windows of anchors that occur more often are grouped one by one.
FREQUENT = 512
#: Bytes of text of a batch at least, hashed at once, of a piece of a long text, of a shard's suffix array, and of text that an owner answers for at a time.
BATCH_BYTES, HASH_BYTES, PIECE_BYTES, SHARD_BYTES, OWNER_BYTES = 2 << 20, 1 << 20, 1 << 20, 1 << 20, 8 << 20
#: Owners at most (or as many as shuffle partitions, if these are more); batches beyond which they grow instead, up to MOST_BATCH bytes; and
#: bytes that an owner regroups at once.
MOST_OWNERS, BATCHES, MOST_BATCH, REGROUP_BYTES = 4096, 1 << 14, 32 << 20, 16 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.random.default_rng(20).integers(1 << 62, 1 << 63, (2, 8), dtype=np.uint64) | np.uint64(1)
_BYTE = np.random.default_rng(21).integers(0, 1 << 63, (2, 256), dtype=np.uint64)
#: Spreads hashes (anchors are small ones) over all values: an odd factor.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: How an anchor of a batch travels, a window of a frequent anchor, a range that an owner removes, and a run of windows of a shard; windows
#: that a task joins at once; and bits of a hash of rid that name the row in which an owner's ranges travel.
ENTRY = np.dtype([("key", "<u8"), ("count", "<u4")])
WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("first", "<i8")])
RANGE = np.dtype([("rid", "<i8"), ("first", "<i8"), ("last", "<i8")])
RUN = np.dtype([("key", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("first", "<i8"), ("size", "<u4")])


WINDOWS_AT_ONCE, RANGE_BITS = 1 << 20, 10


def block_hashes(x: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
    """A hash of x[i : i + size] for each i; near the end it runs into padding. Long x goes in parts, as the steps need many times its size."""
    if len(x) > HASH_BYTES + size:
        return np.concatenate([block_hashes(x[at : at + HASH_BYTES + size], size, kind)[:HASH_BYTES] for at in range(0, len(x), HASH_BYTES)])
    h = _BYTE[kind][np.concatenate([x, np.zeros(size, np.uint8)])]
    width, level = 1, 0
    while 2 * width <= size:
        h = h[:-width] * _ODD[kind][level] + h[width:]
        width, level = 2 * width, level + 1
    if width < size:  # the last piece overlaps the one before
        h = h[: len(x)] * _ODD[kind][7] + h[size - width : size - width + len(x)]
    h = h[: len(x)]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over values[i : i + width], for every i with a full window."""
    step = 1
    while 2 * step <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return pick(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


class Joined:
    """Pieces of text side by side: which offsets begin a K-byte block or a window that lies within one piece."""

    def __init__(self, pieces: list[bytes]):
        self.x = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.left = np.repeat(self.starts + sizes, sizes) - np.arange(len(self.x))  # bytes from here to the piece's end
        self.inside = self.left >= LENGTH

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each block (_NONE across pieces) and smallest hash of each window (_NONE where no window begins)."""
        blocks = np.minimum(block_hashes(self.x, K), _NONE - np.uint64(1))
        blocks[self.left < K] = _NONE
        least = slide(np.concatenate([blocks, np.full(SPAN - 1, _NONE)]), SPAN, np.minimum)
        least[~self.inside] = _NONE
        return blocks, least


def anchor_hashes(blocks: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The hash of every block that is the smallest of a window, once for each of its places (all of them, where several tie)."""
    known = np.where(least == _NONE, np.uint64(0), least)
    highest = slide(np.concatenate([np.zeros(SPAN - 1, np.uint64), known]), SPAN, np.maximum)
    return blocks[(highest == blocks) & (blocks != _NONE)]


def _words(x: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from every offset on as one integer (zeros past the end)."""
    room = np.concatenate([x, np.zeros(LENGTH + 96, np.uint8)])
    return np.ndarray((len(room) - 8,), np.dtype(f"{order}u8"), buffer=room.data, strides=(1,))


def suffix_array(x: np.ndarray, depth: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of x sorted by their first `depth` bytes, ties by place, and each suffix's rank (equal for ties).

    Larsson-Sadakane refinement: a rank is the slot where a group of tied suffixes begins; each round sorts the members of groups that
    still tie by the rank of what follows, which doubles the sorted depth.
    """
    n = len(x)
    first = _words(x, ">")[:n].astype(np.uint64)
    sa = np.argsort(first)
    ordered = first[sa]
    rank = np.empty(n + depth, np.int64)
    rank[n:] = -1
    slot = np.arange(n)
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank[sa] = np.maximum.accumulate(np.where(head, slot, 0))
    tied = slot[~(head & np.concatenate([head[1:], [True]]))]
    done = 8
    while done < depth and len(tied):
        places = sa[tied]
        key = rank[places] << 32 | rank[places + done] + 1
        order = np.argsort(key)
        places, key = places[order], key[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        sa[tied] = places
        rank[places] = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        tied = tied[~(head & np.concatenate([head[1:], [True]]))]
        done *= 2
    if len(tied):
        places = sa[tied]
        sa[tied] = places[np.argsort(rank[places] << 32 | places)]
    return sa, rank[:n]


def common_prefixes(x: np.ndarray, sa: np.ndarray, rank: np.ndarray, least: int = LENGTH, depth: int = 128) -> np.ndarray:
    """For each slot: whether its suffix and the one before share `least` bytes.

    Kasai: going one byte on in the text, the common prefix with the suffix before shrinks by one byte at most. So a value at
    every 32nd place bounds those after it from below and those before it from above; only places that the bounds leave
    open are compared, at every 8th, then every 2nd place, then all. Ties of the full depth stand by place, not by what
    follows, so they bound nothing from below.
    """
    n, cap = len(x), depth
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    tied = np.zeros(n, bool)
    tied[sa[1:]] = rank[sa[1:]] == rank[sa[:-1]]
    words = _words(x, "<")
    shared = np.full(n, -1, np.int64)
    shared[before < 0] = 0
    shared[tied] = depth  # at least
    place = np.arange(n)
    for step in (32, 8, 2, 1):
        known = shared >= 0
        low = np.maximum.accumulate(np.where(known & ~tied, shared + place, -(1 << 40))) - place
        high = np.minimum.accumulate(np.where(known, shared + place, 1 << 40)[::-1])[::-1] - place
        todo = np.flatnonzero(~known & (low < least) & (high >= least) & (place % step == 0))
        a, b, length = todo, before[todo], np.zeros(len(todo), np.int64)
        open_ = np.arange(len(todo))
        for k in range(0, cap, 8):
            gap = words[a[open_] + k].astype(np.uint64) ^ words[b[open_] + k].astype(np.uint64)
            same = gap == 0
            ended = gap[~same]
            length[open_[~same]] = k + np.bitwise_count((ended & (~ended + np.uint64(1))) - np.uint64(1)) // 8
            open_ = open_[same]
            if not len(open_):
                break
        length[open_] = cap
        shared[todo] = length
    known = shared >= 0
    low = np.maximum.accumulate(np.where(known & ~tied, shared + place, -(1 << 40))) - place
    enough = np.where(known, shared >= least, low >= least)
    return enough[sa]


def later_windows(joined: Joined, windows: np.ndarray) -> np.ndarray:
    """Of the windows marked: those that are equal to one at a smaller offset."""
    later = np.zeros(len(joined.x), bool)
    if windows.sum() < 2:
        return later
    sa, rank = suffix_array(joined.x)
    equal = common_prefixes(joined.x, sa, rank)
    heads = np.flatnonzero(~equal)
    first = np.minimum.reduceat(np.where(windows[sa], sa, len(sa)), heads)
    later[sa] = sa != np.repeat(first, np.diff(np.append(heads, len(sa))))
    return later & windows


def _stretches(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last offset of each maximal run of True."""
    edge = np.diff(np.concatenate([[0], marked.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _pieces(text: bytes) -> list[tuple[int, bytes]]:
    """(begin, piece) of a text; each window lies in one piece."""
    return [(at, text[at : at + PIECE_BYTES + LENGTH - 1]) for at in range(0, max(1, len(text) - LENGTH + 1), PIECE_BYTES)]


def layout(total: int, partitions: int) -> tuple[int, int]:
    """For so many bytes of text: the number of owners, and of parts of an owner's range."""
    wanted = max(partitions, -(-total // OWNER_BYTES))
    owners = max(partitions, min(wanted, MOST_OWNERS))
    return owners, -(-wanted // owners)


def batch_bytes(total: int) -> int:
    """Bytes of a batch for so many bytes of text."""
    return max(BATCH_BYTES, min(MOST_BATCH, total // BATCHES))


def _bounds(n: int, owner: int = 0, owners: int = 1) -> np.ndarray:
    """Where the n equal parts of an owner's range of hashes begin."""
    return np.array([(k << 64) // (n * owners) for k in range(owner * n, (owner + 1) * n)], np.uint64)


def _owned(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that have some of the sorted keys, and the cuts between them."""
    cuts = np.append(np.searchsorted(keys, bounds), len(keys))
    used = np.flatnonzero(np.diff(cuts))
    return used, cuts


class Texts(NamedTuple):
    """Stored tables: `single` (rid, doc, doc_id, text, rest, batch) of the texts that are the first of their kind, in batches named by their
    first row, and `copies` (rid, doc_id, size, rest) of the others. doc is the id in the order of documents, rid the reading order."""

    single: DataFrame
    copies: DataFrame
    bytes: int


def split_copies(docs: DataFrame) -> Texts:
    """rest is a struct of the columns besides doc_id and text, if there are any."""
    from pyspark.sql import types as T

    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    columns = [F.monotonically_increasing_id().alias("rid"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("doc"), doc_id.alias("doc_id"), text.alias("text"), *([F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in rest)).alias("rest")] if rest else [])]
    texts = stored(docs.select(*columns).withColumns({"size": F.length("text").cast("long"), "d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), "text")}), "texts")
    ids = texts.select("rid", "doc", "size", "d1", "d2").where(F.col("size") >= LENGTH)
    firsts = ids.groupBy("d1", "d2", "size").agg(F.min(F.struct("doc", "rid")).alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = stored(firsts.select("d1", "d2", "size", F.col("f.rid").alias("f_rid")), "repeated-texts")
    later = stored(ids.join(firsts, ["d1", "d2", "size"]).where("rid <> f_rid").select("rid"), "later-texts")
    given = texts.drop("size", "d1", "d2")
    total = ids.agg(F.sum("size")).first()[0] or 0
    most = batch_bytes(total)
    schema = T.StructType([*given.schema.fields, T.StructField("batch", T.LongType())])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = 0, most
        for part in batches:
            of = []
            for rid, size in zip(part.column(0).to_pylist(), pc.binary_length(part.column(3)).to_pylist(), strict=True):
                if held >= most:
                    now, held = rid, 0
                held += size
                of.append(now)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of, pa.int64())], names=names)

    single = stored(given.join(later, "rid", "left_anti").mapInArrow(work, schema), "single-texts")
    copies = stored(texts.join(later, "rid", "left_semi").select("rid", "doc_id", "size", *(["rest"] if rest else [])), "copies")
    used_up(texts, firsts, later)
    return Texts(single, copies, total)


def anchor_rows(texts: DataFrame, owners: int) -> DataFrame:
    """(owner, batch, anchors): the packed keys and counts of a batch's anchors, a row for each owner that has some."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(owners)
        now, pieces, size = None, [], 0
        held: list[np.ndarray] = []

        def hashed() -> None:
            """Take the pieces that wait."""
            nonlocal pieces, size
            joined = Joined(pieces)
            if joined.inside.any():
                held.append(_counted((anchor_hashes(*joined.anchors()) * _SPREAD) & ~np.uint64(1), None))
            pieces, size = [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            """Send what is held of a batch."""
            nonlocal held
            if held:
                every = np.concatenate(held)
                packed = _counted(every["key"], every["count"]) if len(held) > 1 else every
                used, cuts = _owned(packed["key"], bounds)
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([now] * len(used), pa.int64()), pa.array([packed[cuts[k] : cuts[k + 1]].tobytes() for k in used], pa.binary())], names=["owner", "batch", "anchors"])
            held = []

        for part in batches:
            for batch, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                if batch != now:
                    if pieces:
                        hashed()
                    yield from closed()
                    now = batch
                for _, piece in _pieces(text):
                    if pieces and size >= HASH_BYTES:
                        hashed()
                        if sum(x.nbytes for x in held) >= REGROUP_BYTES:  # a text that is far longer than a batch
                            yield from closed()
                    pieces.append(piece)
                    size += len(piece)
        if pieces:
            hashed()
        yield from closed()

    return texts.select("batch", "text").mapInArrow(work, "owner int, batch long, anchors binary")


def _counted(keys: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
    """Sorted ENTRY rows of the different keys, each with the sum of its counts (one a key if there are none)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = _heads(keys)
    packed = np.zeros(len(first), ENTRY)
    packed["key"] = keys[first]
    packed["count"] = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)
    return packed


def by_range(rows: DataFrame, dtype: np.dtype, owners: int, parts: int) -> DataFrame:
    """Rows (owner, name, meta, body) as (part, names, metas, bodies), one task an owner, sorted by part of the owner's range of hashes.

    meta holds items of dtype, sorted by its first field, a hash; body the bytes of each item one after another (their number is its
    `size`), or null. A row is cut at the bounds of the parts; its cuts travel with those of other rows that an owner regroups at once.
    """
    columns = ["name", "meta", "body"]
    dealt = rows.repartitionById(owners, "owner")
    if parts == 1:
        return dealt.select(F.lit(0).cast("long").alias("part"), *(F.array(c).alias(f"{c}s") for c in columns))
    key = dtype.names[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        of, bounds, size = None, np.zeros(0, np.uint64), 0

        def flush() -> pa.RecordBatch:
            used = sorted(held)
            kinds = (pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array([held[p][k] for p in used], pa.list_(kind)) for k, kind in enumerate(kinds))], names=["part", *(f"{c}s" for c in columns)])

        for batch in batches:
            for owner, name, meta, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if owner != of:
                    of, bounds = owner, _bounds(parts, owner, owners)
                items = np.frombuffer(meta, dtype)
                used, cuts = _owned(items[key], bounds)
                ends = None if body is None else np.concatenate([[0], np.cumsum(items["size"], dtype=np.int64)])
                for k in used.tolist():
                    a, b = cuts[k], cuts[k + 1]
                    row = name, items[a:b].tobytes(), None if ends is None else body[ends[a] : ends[b]]
                    for mine, new in zip(held.setdefault(owner * parts + k, ([], [], [])), row, strict=True):
                        mine.append(new)
                size += len(meta) + len(body or b"")
                if size >= REGROUP_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    cut = dealt.select("owner", *columns).mapInArrow(work, "part long, names array<long>, metas array<binary>, bodies array<binary>")
    return cut.sortWithinPartitions("part")


def _each_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """The names, metas and bodies of each part in the rows of by_range."""
    now, held = None, ([], [], [])
    for batch in batches:
        for part, *lists in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if part != now:
                if now is not None:
                    yield held
                now, held = part, ([], [], [])
            for mine, new in zip(held, lists, strict=True):
                mine.extend(new)
    if now is not None:
        yield held


def repeated_anchors(texts: DataFrame, owners: int, parts: int = 1) -> DataFrame:
    """A stored table (batch, keys): packed keys of the anchors of a batch that occur more than once in all; the lowest bit says whether they
    do so over FREQUENT times."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple[np.ndarray, np.ndarray]] = []

        def replies() -> pa.RecordBatch:
            """What is to be told, a row a batch; its keys stay sorted."""
            of, keys = (np.concatenate(x) for x in zip(*told, strict=True))
            by = np.argsort(of, kind="stable")
            of, keys = of[by], keys[by]
            heads = _heads(of)
            cuts = np.append(heads, len(of)).tolist()
            return pa.RecordBatch.from_arrays([pa.array(of[heads]), pa.array([keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["batch", "keys"])

        for names, metas, _ in _each_part(batches):
            sent = [np.frombuffer(x, ENTRY) for x in metas]
            every = np.concatenate(sent)
            order = np.argsort(every["key"], kind="stable")
            keys = every["key"][order]
            heads = _heads(keys)
            total = np.repeat(np.add.reduceat(every["count"][order].astype(np.int64), heads), np.diff(np.append(heads, len(keys))))
            again = total > 1
            if again.any():
                of = np.repeat(np.array(names, np.int64), [len(p) for p in sent])[order]
                told.append((of[again], (keys | (total > FREQUENT).astype(np.uint64))[again]))
                if sum(x.nbytes for x, _ in told) >= REGROUP_BYTES:
                    yield replies()
                    told = []
        if told:
            yield replies()

    rows = anchor_rows(texts, owners).select("owner", F.col("batch").alias("name"), F.col("anchors").alias("meta"), F.lit(None).cast("binary").alias("body"))
    return stored(by_range(rows, ENTRY, owners, parts).mapInArrow(answered, "batch long, keys binary"), "anchors")


def _heads(values: np.ndarray) -> np.ndarray:
    """The first place of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])


def _coded(least: np.ndarray, replies: np.ndarray) -> np.ndarray:
    """For each window: 0 if its anchor is not among the replies (sorted), 1 if it is, 2 if it is frequent."""
    code = np.zeros(len(least), np.uint8)
    if not len(least) or not len(replies):
        return code
    heads = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    wanted = (least[heads] * _SPREAD) & ~np.uint64(1)
    keys = replies & ~np.uint64(1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = (keys[at] == wanted) & (least[heads] != _NONE)
    each = np.where(hit, 1 + (replies[at] & np.uint64(1)).astype(np.uint8), 0).astype(np.uint8)
    return np.repeat(each, np.diff(np.append(heads, len(least))))


class _Stretch(NamedTuple):
    """Bytes of a text from `begin` on, with the code and the anchor of each window (none begins at the last bytes)."""

    doc: int
    rid: int
    begin: int
    bytes: bytes
    code: np.ndarray
    least: np.ndarray


ROUTED = "kind int, owner int, rid long, spans array<long>, meta binary, body binary"
_KINDS = {"kind": pa.int32(), "owner": pa.int32(), "rid": pa.int64(), "spans": pa.list_(pa.int64()), "meta": pa.binary(), "body": pa.binary()}


def _routed(kind: int, n: int, **given) -> pa.RecordBatch:
    given["kind"] = np.full(n, kind, np.int32)
    columns = [pa.nulls(n, t) if c not in given else given[c] if isinstance(given[c], pa.Array) else pa.array(given[c], t) for c, t in _KINDS.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(_KINDS))


def _spans(rid: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Row ids, and for each a list of its ranges: first, last, first, last and so on."""
    order = np.argsort(rid, kind="stable")
    rid, flat = rid[order], np.stack([first[order], last[order]], 1).ravel()
    heads = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]])) if len(rid) else np.zeros(0, np.int64)
    return rid[heads], pa.ListArray.from_arrays(pa.array(np.append(2 * heads, len(flat)).astype(np.int32)), pa.array(flat))


def shard(stretches: list[_Stretch], owners: int, often: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What a shard removes (kind 0: rid, spans) and its runs of windows that stay (kind 1: owner, meta, body, sorted by anchor). Windows of
    frequent anchors that stay are added to `often`."""
    stretches.sort(key=lambda s: s[:3])  # offsets then stand in the order of documents
    joined = Joined([s.bytes for s in stretches])
    code, least = np.concatenate([s.code for s in stretches]), np.concatenate([s.least for s in stretches])
    doc, rid, begin = (np.array([s[k] for s in stretches], np.int64) for k in range(3))
    windows = joined.inside & (code > 0)
    later = later_windows(joined, windows)

    def where(offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(joined.starts, offset, "right") - 1
        return at, offset - joined.starts[at] + begin[at]

    first, last = _stretches(later)  # a run of windows lies within one stretch, as none begins at its last bytes
    if len(first):
        at, place = where(first)
        ids, spans = _spans(rid[at], place, place + last - first + LENGTH)
        yield _routed(0, len(ids), rid=ids, spans=spans)
    stays = windows & ~later
    frequent = np.flatnonzero(stays & (code == 2))
    if len(frequent):
        at, place = where(frequent)
        found = np.zeros(len(frequent), WINDOW)
        found["h1"], found["h2"] = (block_hashes(joined.x, LENGTH, kind)[frequent] for kind in (0, 1))
        found["doc"], found["rid"], found["first"] = doc[at], rid[at], place
        often.append(found)
    run = np.where(stays & (code == 1), least, _NONE)
    heads = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1])]))
    tails = np.append(heads[1:], len(run)) - 1
    real = run[heads] != _NONE
    heads, tails = heads[real], tails[real]
    if len(heads):
        # of SPAN windows at most, so that the first and the last one cover a run; only ties of an anchor make longer ones
        parts = -(-(tails - heads + 1) // SPAN)
        heads, ends = np.repeat(heads, parts), np.repeat(tails, parts)
        heads = heads + SPAN * (np.arange(len(heads)) - np.repeat(np.cumsum(parts) - parts, parts))
        tails = np.minimum(heads + SPAN - 1, ends)
        key = run[heads] * _SPREAD
        order = np.argsort(key, kind="stable")
        heads, tails, key = heads[order], tails[order], key[order]
        at, place = where(heads)
        meta = np.zeros(len(heads), RUN)
        meta["key"], meta["doc"], meta["rid"], meta["first"], meta["size"] = key, doc[at], rid[at], place, tails - heads + LENGTH
        used, cuts = _owned(key, _bounds(owners))
        raw, ends = joined.x.tobytes(), tails + LENGTH
        bodies = [b"".join([raw[a:b] for a, b in zip(heads[cuts[k] : cuts[k + 1]].tolist(), ends[cuts[k] : cuts[k + 1]].tolist(), strict=True)]) for k in used]
        yield _routed(1, len(used), owner=used.astype(np.int32), meta=[meta[cuts[k] : cuts[k + 1]].tobytes() for k in used], body=bodies)


def first_windows(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with equal hashes the first in the order of documents, sorted by hash; and the others."""
    every = np.concatenate(parts)
    every = every[np.lexsort([every[c] for c in ("first", "rid", "doc", "h2", "h1")])]
    new = np.concatenate([[True], (every["h1"][1:] != every["h1"][:-1]) | (every["h2"][1:] != every["h2"][:-1])])
    return every[new], every[~new]


def _joined_windows(often: list[np.ndarray], owners: int) -> Iterator[pa.RecordBatch]:
    """What a task removes of its shards' windows of frequent anchors (kind 0), and the others, cut into owners' ranges (kind 2: owner, meta)."""
    if not often:
        return
    kept, later = first_windows(often)
    if len(later):
        ids, spans = _spans(later["rid"].copy(), later["first"].copy(), later["first"] + LENGTH)
        yield _routed(0, len(ids), rid=ids, spans=spans)
    used, cuts = _owned(kept["h1"], _bounds(owners))
    yield _routed(2, len(used), owner=used.astype(np.int32), meta=[kept[cuts[k] : cuts[k + 1]].tobytes() for k in used])


def shard_rows(texts: DataFrame, replies: DataFrame, owners: int) -> DataFrame:
    """ROUTED rows of all shards. A batch's replies and texts meet by its name."""

    def stretches(rows: list[tuple[int, int, int, bytes]], keys: np.ndarray) -> Iterator[_Stretch]:
        """Of pieces (doc, rid, begin, bytes)."""
        joined = Joined([r[3] for r in rows])
        least = joined.anchors()[1]
        code = _coded(least, keys)
        first, last = _stretches(code > 0)
        if not len(first):
            return
        # those whose bytes overlap are one; across pieces none do
        new = np.concatenate([[True], first[1:] >= last[:-1] + LENGTH])
        begin, end = first[new], last[np.concatenate([new[1:], [True]])] + LENGTH
        at = np.searchsorted(joined.starts, begin, "right") - 1
        for k, a, b, start in zip(at.tolist(), begin.tolist(), end.tolist(), joined.starts[at].tolist(), strict=True):
            doc, rid, offset, piece = rows[k]
            yield _Stretch(doc, rid, offset + a - start, piece[a - start : b - start], code[a:b], least[a:b])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys = None, []
        rows: list[tuple[int, int, int, bytes]] = []
        held: list[_Stretch] = []
        often: list[np.ndarray] = []
        waiting = size = 0

        def closed() -> Iterator[pa.RecordBatch]:
            """Take the rows that wait, all of one batch."""
            nonlocal rows, keys, held, often, waiting, size
            if rows and keys:
                if len(keys) > 1:
                    keys = [np.unique(np.concatenate(keys))]
                for found in stretches(rows, keys[0]):
                    held.append(found)
                    size += len(found.bytes)
                    if size >= SHARD_BYTES:
                        yield from shard(held, owners, often)
                        held, size = [], 0
                        if sum(map(len, often)) >= WINDOWS_AT_ONCE:
                            yield from _joined_windows(often, owners)
                            often = []
            rows, waiting = [], 0

        for part in runs(batches, HASH_BYTES):
            for batch, side, rid, doc, text in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                if batch != now:
                    yield from closed()
                    now, keys = batch, []
                if side == 0:
                    keys.append(np.frombuffer(text, "<u8"))
                    continue
                for begin, piece in _pieces(text) if keys else ():
                    rows.append((doc, rid, begin, piece))
                    waiting += len(piece)
                    if waiting >= HASH_BYTES:
                        yield from closed()
        yield from closed()
        if held:
            yield from shard(held, owners, often)
        yield from _joined_windows(often, owners)

    none = F.lit(None).cast("long")
    asked = replies.select("batch", F.lit(0).alias("side"), none.alias("rid"), none.alias("doc"), F.col("keys").alias("x"))
    told = texts.select("batch", F.lit(1).alias("side"), "rid", "doc", F.col("text").alias("x"))
    return asked.union(told).repartition("batch").sortWithinPartitions("batch", "side", "doc", "rid").mapInArrow(work, ROUTED)


class Sorted(NamedTuple):
    """Things of a shard, sorted by key: their order in the corpus and where their bytes begin."""

    key: np.ndarray
    order: np.ndarray
    place: np.ndarray


class Collision(Exception):
    """Two different strings with one hash."""


def merge_sorted(arrays: list[Sorted], equal) -> tuple[Sorted, np.ndarray]:
    """The arrays (none with a key twice) as one, two and two by binary search of the one's keys in the other's; of equal things the first
    in order stays. Also the places of those that don't. equal(places, places) tells whether their bytes are the same."""
    gone: list[np.ndarray] = []

    def two(a: Sorted, b: Sorted) -> Sorted:
        if len(a.key) < len(b.key):
            a, b = b, a
        at = np.searchsorted(a.key, b.key)
        hit = a.key[np.minimum(at, len(a.key) - 1)] == b.key
        here, there = at[hit], np.flatnonzero(hit)
        if len(here):
            if not equal(a.place[here], b.place[there]):
                raise Collision
            earlier = b.order[there] < a.order[here]
            gone.append(np.where(earlier, a.place[here], b.place[there]))
            order, place = a.order.copy(), a.place.copy()
            order[here[earlier]], place[here[earlier]] = b.order[there[earlier]], b.place[there[earlier]]
            a = Sorted(a.key, order, place)
        new = ~hit
        return Sorted(*(np.insert(x, at[new], y[new]) for x, y in zip(a, b, strict=True))) if new.any() else a

    while len(arrays) > 1:
        arrays.sort(key=lambda x: len(x.key))
        arrays = [two(*arrays[k : k + 2]) if k + 1 < len(arrays) else arrays[k] for k in range(0, len(arrays), 2)]
    return arrays[0], np.concatenate([np.zeros(0, np.int64), *gone])


def _bytes_equal(x: np.ndarray, size: int):
    """equal(a, b) for merge_sorted: whether the `size` bytes from each place are the same."""
    words = _words(x, "<")

    def equal(a: np.ndarray, b: np.ndarray) -> bool:
        return all(np.array_equal(words[a[at : at + 65536] + k], words[b[at : at + 65536] + k]) for at in range(0, len(a), 65536) for k in [*range(0, size - 7, 8), size - 8])

    return equal


def merge_runs(metas: list[np.ndarray], bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, first, last) of the windows that stand earlier in another shard; metas and bodies are one shard's runs each.

    Whole runs meet first: a run is known by the hashes of its first and last window, which cover it, and its size. Then the windows of
    those that stay and share their anchor with a run that differs.
    """
    meta = np.concatenate(metas)
    x = np.frombuffer(b"".join(bodies), np.uint8)
    size = meta["size"].astype(np.int64)
    start = np.cumsum(size) - size
    by = np.lexsort((meta["first"], meta["rid"], meta["doc"]))
    order = np.empty(len(meta), np.int64)
    order[by] = np.arange(len(meta))
    owner_cuts = np.cumsum([0, *map(len, metas)])
    hashes, equal = block_hashes(x, LENGTH, 1), _bytes_equal(x, LENGTH)
    last = start + size - LENGTH
    gone = np.zeros(len(x), bool)
    try:
        whole = hashes[start] * _ODD[0][0] + hashes[last] * _ODD[0][1] + size.astype(np.uint64)
        lists = []
        for a, b in zip(owner_cuts, owner_cuts[1:], strict=False):
            at = a + np.argsort(whole[a:b], kind="stable")
            if (whole[at][1:] == whole[at][:-1]).any():
                raise Collision
            lists.append(Sorted(whole[at], order[at], at))
        same_runs = lambda a, b: np.array_equal(size[a], size[b]) and equal(start[a], start[b]) and equal(last[a], last[b])
        kept, dropped = merge_sorted(lists, same_runs)
        stays = np.zeros(len(meta), bool)
        stays[kept.place] = True
        _mark(gone, start[dropped], last[dropped])
        # windows of runs whose anchor another run that stays has too
        keys, counts = np.unique(meta["key"][stays], return_counts=True)
        shared = stays & (counts[np.minimum(np.searchsorted(keys, meta["key"]), len(keys) - 1)] > 1)
        shard_of = np.repeat(np.arange(len(metas)), [len(m) for m in metas])
        lists = []
        some = np.flatnonzero(shared)
        cuts = np.searchsorted(shard_of[some], np.arange(len(metas) + 1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            at = some[a:b]
            count = last[at] - start[at] + 1
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = np.repeat(start[at], count) + offset
            key = hashes[place]
            sort = np.argsort(key)
            if (key[sort][1:] == key[sort][:-1]).any():
                raise Collision
            lists.append(Sorted(key[sort], (np.repeat(order[at], count) << 8 | offset)[sort], place[sort]))
        if len(lists) > 1:
            gone[merge_sorted(lists, equal)[1]] = True
    except Collision:  # next to never; then one suffix array of all runs, in the order of documents
        joined = Joined([x[start[k] : start[k] + size[k]].tobytes() for k in by])
        later = later_windows(joined, joined.inside)
        gone[:] = False
        for slot, k in enumerate(by.tolist()):
            begin = joined.starts[slot]
            gone[start[k] : start[k] + size[k]] = later[begin : begin + size[k]]
    first, end = _stretches(gone)  # no window begins at a run's last bytes
    run = np.searchsorted(start, first, "right") - 1
    place = meta["first"][run] + first - start[run]
    return meta["rid"][run], place, place + end - first + LENGTH


def _mark(gone: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
    edge = np.zeros(len(gone) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    gone |= np.cumsum(edge[:-1]) > 0


def _sent(routes: DataFrame, kind: int, dtype: np.dtype, owners: int, parts: int) -> DataFrame:
    return by_range(routes.where(F.col("kind") == kind).select("owner", F.lit(None).cast("long").alias("name"), "meta", "body"), dtype, owners, parts)


def _told(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Ranges (rid, first, last) as rows (bucket, ranges), those of about REGROUP_BYTES together. A text's ranges are spread over the owners of
    its anchors, so a row for each text and owner would be many short ones, and more for each text the more owners there are."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        every = np.concatenate(held)
        bucket = (every["rid"].astype(np.uint64) * _SPREAD) >> np.uint64(64 - RANGE_BITS)
        order = np.argsort(bucket, kind="stable")
        every, bucket = every[order], bucket[order].astype(np.int32)
        heads = _heads(bucket)
        cuts = np.append(heads, len(bucket)).tolist()
        return pa.RecordBatch.from_arrays([pa.array(bucket[heads]), pa.array([every[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["bucket", "ranges"])

    for columns in found:
        held.append(np.empty(len(columns[0]), RANGE))
        for name, values in zip(RANGE.names, columns, strict=True):
            held[-1][name] = values
        size += held[-1].nbytes
        if size >= REGROUP_BYTES:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


TOLD = "bucket int, ranges binary"


def by_text(told: DataFrame) -> DataFrame:
    """(rid, spans) from the rows of _told; a text has a row for each REGROUP_BYTES of ranges of its bucket, mostly one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            ids, spans = _spans(*(every[c] for c in RANGE.names))
            return pa.RecordBatch.from_arrays([pa.array(ids), spans], names=["rid", "spans"])

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(np.frombuffer(raw, RANGE))
                size += len(raw)
                if size >= REGROUP_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return told.repartition("bucket").sortWithinPartitions("bucket").select("ranges").mapInArrow(work, "rid long, spans array<long>")


def merged_runs(routes: DataFrame, owners: int, parts: int = 1) -> DataFrame:
    """TOLD rows of the windows in runs (kind 1) that stand earlier in another shard; one task an owner."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what one shard sends has no two equal windows
        yield from _told(merge_runs([np.frombuffer(m, RUN) for m in metas], bodies) for _, metas, bodies in _each_part(batches) if len(metas) > 1)

    return _sent(routes, 1, RUN, owners, parts).mapInArrow(work, TOLD)


def frequent_windows(routes: DataFrame, owners: int, parts: int = 1) -> DataFrame:
    """TOLD rows of the windows of frequent anchors (kind 2) that stand earlier in what another task sent; one task an owner."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later = (first_windows([np.frombuffer(m, WINDOW) for m in metas])[1] for _, metas, _ in _each_part(batches) if len(metas) > 1)
        yield from _told((x["rid"], x["first"], x["first"] + LENGTH) for x in later)

    return _sent(routes, 2, WINDOW, owners, parts).mapInArrow(work, TOLD)


def removed_ranges(texts: Texts) -> DataFrame:
    """A stored table (rid, spans): the ranges to cut from single texts."""
    spark = texts.single.sparkSession
    owners, parts = layout(texts.bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # stored, so that one step's shuffle is gone before the next one's comes
    replies = repeated_anchors(texts.single, owners, parts)
    release(spark)
    routes = stored(shard_rows(texts.single, replies, owners), "routes")
    used_up(replies)
    release(spark)
    told = merged_runs(routes, owners, parts).union(frequent_windows(routes, owners, parts))
    spans = routes.where("kind = 0").select("rid", "spans").union(by_text(told))
    cuts = stored(spans.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "cuts")
    used_up(routes)
    release(spark)
    return cuts


def merge_ranges(spans: np.ndarray) -> list[tuple[int, int]]:
    """Ranges (first, last, first, last and so on) sorted, with those that meet or overlap joined."""
    a = spans.reshape(-1, 2)
    if not len(a):
        return []
    a = a[np.argsort(a[:, 0], kind="stable")]
    end = np.maximum.accumulate(a[:, 1])
    new = np.concatenate([[True], a[1:, 0] > end[:-1]])
    return list(zip(a[new, 0].tolist(), end[np.concatenate([new[1:], [True]])].tolist(), strict=True))


def deduplicate(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs (doc_id, text). with_text: also kept (the bytes that
    stay) and rest (a struct of docs' other columns, if it has any)."""
    from pyspark.sql import types as T

    texts = split_copies(docs)
    ranges = removed_ranges(texts)
    long = T.LongType()
    fields = [T.StructField(c, long) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    extra = ["rest"] if with_text and "rest" in texts.single.columns else []
    if with_text:
        fields += [T.StructField("kept", T.BinaryType()), *(texts.single.schema[c] for c in extra)]
    names = [f.name for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, BATCH_BYTES):
            rows, kept, spans = [], [], batch.column(2)
            edges, flat, known = spans.offsets.to_numpy(), spans.values.to_numpy(), spans.is_valid().to_pylist()
            for k, text in enumerate(texts_of(batch.column(1))):
                cuts = merge_ranges(flat[edges[k] : edges[k + 1]]) if known[k] else []
                at, parts = 0, []
                for a, b in cuts:
                    parts.append(text[at:a])
                    at = b
                kept.append(b"".join([*parts, text[at:]]))
                rows.append((len(text), len(text) - len(kept[-1]), len(cuts), hashlib.sha256(kept[-1]).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *([pa.array(kept, pa.binary())] if with_text else []), *(batch.column(3) for _ in extra)], names=names)

    joined = texts.single.join(ranges, "rid", "left").select("doc_id", "text", "spans", *extra)
    whole = {"n_bytes": F.col("size"), "n_removed": F.col("size"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "kept": F.lit(b"")}
    gone = texts.copies.select(*(whole[c].alias(c) if c in whole else F.col(c) for c in names))
    return joined.mapInArrow(work, T.StructType(fields)).union(gone)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
