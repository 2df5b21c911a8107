"""SimHash near-duplicates: bit-sliced comparison inside buckets and connected components of the links.

Fingerprints of one or more 64-bit words come from the XXH64 values of word shingles. Nodes meet in buckets. Inside a bucket
the bits lie in planes (one word holds one bit of 64 fingerprints); a query is compared with 64 lanes at a time by carry-save
counters, and a block of lanes is left as soon as all are beyond the radius. Each bucket yields a star for each of its
components, so rows stay in proportion to the input, and large-star / small-star rounds join the stars. Two uses:

* near_duplicates: equal fingerprints (64 bits, repeats of a shingle counted) are one node, and nodes within the radius are linked.
  The 64 bits are cut into radius + 2 blocks and every pair of blocks is a table of buckets, so two fingerprints within the
  radius always share one: no link is lost.
* near_copies: texts with an equal set of distinct shingles are one node, and nodes with a Jaccard similarity of SIMILAR or more are
  linked. SimHash finds groups: nodes that share a block of smallest shingle hashes are compared by fingerprints of COPY_WORDS
  words, within COPY_RADIUS. Then the sets themselves decide: each is sent once, to its group, where pairs that are near by
  fingerprint and not yet joined are compared exactly. Tables of fingerprint bits would lose pairs at the bound or grow with the square
  of the input; a pair at 0.8 shares none of the BLOCKS blocks with a chance of 3e-6. Bits differ in a share of 0.16 there (0.19
  for sets of four and five shingles), so the radius lies over three deviations beyond.

Rows: null, empty and wordless texts have fingerprint zero (near_duplicates) or the empty set (near_copies) and link like any other.
Rows with a null id get a fingerprint and the component of it; in a component ids come first, then nulls. Equal ids with different
texts are separate nodes of near_copies; in near_duplicates an id stands for its fingerprints' smallest owner. Empty tables give
empty results; other columns are ignored, whatever their names. No bucket or group has a cap: larger ones are split into
parts that meet pairwise, each pair of parts in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prooflake.llm.common import runs, stored, table, texts_of, used_up

SEED = 42
#: Shingles whose bits are counted at once, rows of planes that are built at once, and (query, block) pairs compared at once.
SHINGLES_AT_ONCE, ROWS_AT_ONCE, PAIRS_AT_ONCE, SET_BYTES = 1 << 12, 1 << 14, 1 << 15, 32 << 20
#: Buckets with more nodes, and groups with more bytes of shingle sets and nodes, are dealt to several tasks. A node counts as NODE_BYTES beside its
#: set, its fingerprint and place, so that very many short texts are a large group too.
HOT_BUCKET, HOT_BYTES, NODE_BYTES = 20_000, 4 << 20, 256
#: SIMILAR is a fraction, so that the comparison is one of whole numbers. Fingerprint words and radius of near_copies, its blocks and
#: the smallest hashes that make one.
SIMILAR, COPY_WORDS, COPY_RADIUS, BLOCKS, BLOCK_ROWS = (4, 5), 16, 232, 24, 4
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 64, BLOCKS * BLOCK_ROWS, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, BLOCKS * BLOCK_ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes, width: int) -> list[bytes]:
    """Word shingles, repeats included; a shorter text is one shingle, a text without words none."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    if len(words) <= width:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent word made of a hash (the hash itself for 0), by a splitmix64 round."""
    if k == 0:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def hashes(units: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, units, [SEED] * len(units)), np.uint64, len(units))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    return np.unique(hashes(list(set(shingles(text, width)))))


def majority(h: np.ndarray, words: int = 1) -> bytes:
    """8 * words bytes, each word big-endian: a bit is set if over half the hashes have it."""
    counts = np.zeros(64 * words, np.int64)
    for k in range(words):
        for at in range(0, len(h), SHINGLES_AT_ONCE):
            bits = np.unpackbits(_mixed(h[at : at + SHINGLES_AT_ONCE], k).astype(">u8").view(np.uint8)).reshape(-1, 64)
            for row in range(0, len(bits), 255):  # counts up to 255 fit in the bits' own type
                counts[64 * k : 64 * k + 64] += np.add.reduce(bits[row : row + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h)).tobytes()


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp binary) of every row; one narrow pass over whole texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 8 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([majority(hashes(shingles(t, width))) for t in texts_of(batch.column(1))], pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, fp binary")


def exact_tables(radius: int) -> list[list[tuple[int, int]]]:
    """Tables of (first bit, bits) for 64 bits: radius errors leave two of radius + 2 blocks untouched."""
    blocks = radius + 2
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [list(pair) for pair in combinations(parts, 2)]


def _keyed(nodes: DataFrame, tables: list[list[tuple[int, int]]]) -> DataFrame:
    """(bucket, node, fp) of each node in each table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = batch.column(1).to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1).astype(np.int64)
            for k, parts in enumerate(tables):
                value = np.full(len(fps), k, np.int64)
                for first, n in parts:
                    value = value << n | bits[:, first : first + n] @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(value), batch.column(0), batch.column(1)], names=["bucket", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(work, "bucket long, node long, fp binary")


def _save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three planes."""
    u = a ^ b
    return u ^ c, a & b | u & c


class _Counter:
    """Bit-sliced counts of up to 64 lanes a word; planes come in eights."""

    def __init__(self, shape: int, limit: int):
        self.low = [np.zeros(shape, np.uint64) for _ in range(3)]
        self.high = [np.zeros(shape, np.uint64) for _ in range(max(1, limit.bit_length() - 2))]

    def add(self, p: list[np.ndarray]) -> None:
        ones, twos, fours = self.low
        ones, a = _save(ones, p[0], p[1])
        ones, b = _save(ones, p[2], p[3])
        twos, e = _save(twos, a, b)
        ones, a = _save(ones, p[4], p[5])
        ones, b = _save(ones, p[6], p[7])
        twos, f = _save(twos, a, b)
        fours, carry = _save(fours, e, f)
        self.low = [ones, twos, fours]
        for k in range(len(self.high) - 1):
            self.high[k], carry = self.high[k] ^ carry, self.high[k] & carry
        self.high[-1] |= carry  # saturates: counts past the top stay past the limit

    def over(self, limit: int) -> np.ndarray:
        """Lanes whose count is above limit."""
        above = np.zeros_like(self.low[0])
        level = ~above
        counts = [*self.low, *self.high]
        for k in reversed(range(len(counts))):
            if limit >> k & 1:
                level &= counts[k]
            else:
                above |= level & counts[k]
                level &= ~counts[k]
        return above

    def keep(self, at: np.ndarray) -> None:
        self.low = [c[at] for c in self.low]
        self.high = [c[at] for c in self.high]


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the trees of i and j; the smallest index of a tree is its root and label stays fully compressed."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up


def _confirm(label: np.ndarray, i: np.ndarray, j: np.ndarray, same: Callable[[int, int], bool]) -> np.ndarray:
    """As _hook, for those pairs that `same` confirms; it isn't asked about pairs that are joined already."""
    root = label.tolist()

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    apart = label[i] != label[j]
    for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y and same(a, b):
            root[max(x, y)] = min(x, y)
    return np.array([find(k) for k in range(len(root))])


def linked(bits: np.ndarray, starts: np.ndarray, radius: int, same: Callable[[int, int], bool] | None = None, joined: np.ndarray | None = None) -> np.ndarray:
    """For rows sorted by bucket (bits: rows x bits of 0/1; starts: first row of each bucket): each row's root in its bucket,
    the first row that it reaches over links. A link is a pair of at most radius differing bits that `same`, if given, confirms.
    Rows marked as joined stand last in their bucket, are linked to each other from the start, and are compared with the others only."""
    n, width = bits.shape
    lanes = -(-n // 64)
    padded = np.zeros((lanes * 64, width), np.uint8)
    padded[:n] = bits
    planes = np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)
    signs = (np.uint64(0) - padded.T.astype(np.uint64)) if n * width <= 1 << 22 else None
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    label = np.arange(n)
    first, last = np.arange(n) // 64, (ends - 1) // 64
    wanted = np.flatnonzero(ends - np.arange(n) > 1)
    if joined is not None and joined.any():
        wanted = wanted[~joined[wanted]]
        heads = np.flatnonzero(joined & np.append(True, ~joined[:-1] | np.isin(np.arange(1, n), starts)))
        label[joined] = heads[np.searchsorted(heads, np.flatnonzero(joined), "right") - 1]
    spans = (last - first + 1)[wanted]
    done = np.concatenate([[0], np.cumsum(spans)])
    # where pairs must be confirmed, few queries go first: what they join needn't be looked at again
    at, most = 0, PAIRS_AT_ONCE if same is None else 64
    while at < len(wanted):
        to = max(at + 1, int(np.searchsorted(done, done[at] + most, "right")) - 1)
        most = min(2 * most, PAIRS_AT_ONCE)
        query = np.repeat(wanted[at:to], spans[at:to])
        word = first[query] + np.arange(len(query)) - np.repeat(done[at:to] - done[at], spans[at:to])
        at = to
        low = np.clip(query + 1 - 64 * word, 0, 64).astype(np.uint64)
        high = np.clip(ends[query] - 64 * word, 0, 64).astype(np.uint64)
        ones = ~np.uint64(0)
        mask = np.where(high == 64, ones, (np.uint64(1) << np.minimum(high, np.uint64(63))) - np.uint64(1))
        mask &= np.where(low == 64, np.uint64(0), ones << np.minimum(low, np.uint64(63)))
        keep = mask != 0
        query, word, mask = query[keep], word[keep], mask[keep]
        counter = _Counter(len(query), radius)
        for plane in range(0, width, 8):
            counter.add([planes[p][word] ^ (signs[p][query] if signs is not None else np.uint64(0) - padded[query, p].astype(np.uint64)) for p in range(plane, plane + 8)])
            if plane + 8 > radius and plane % 16 == 8 or plane + 8 == width:  # leave the blocks whose lanes are all beyond the radius
                close = ~counter.over(radius) & mask
                near = close != 0
                if not near.all():
                    query, word, mask, close = query[near], word[near], mask[near], close[near]
                    counter.keep(near)
                if not len(query):
                    break
        if len(query):
            k, lane = np.nonzero(np.unpackbits(close.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            label = _hook(label, query[k], 64 * word[k] + lane) if same is None else _confirm(label, query[k], 64 * word[k] + lane, same)
    return label


def alike(x: np.ndarray, y: np.ndarray, similar: tuple[int, int]) -> bool:
    """Whether two sorted sets share the fraction `similar` of their union."""
    if len(x) > len(y):
        x, y = y, x
    if similar[1] * len(x) < similar[0] * len(y):
        return False
    at = np.searchsorted(y, x)
    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
    return similar[1] * shared >= similar[0] * (len(x) + len(y) - shared)


def _heads(bucket: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))


def _stars(batches: Iterator[pa.RecordBatch], radius: int, similar: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """(a, b): a links to b or reaches it inside a bucket; a < b. Rows (bucket, node, fp) come sorted by bucket; with `similar` also
    each node's set of hashes, of which a pair must share that fraction, and whether it is joined (these come last in a bucket)."""

    def flush(bucket: np.ndarray, node: np.ndarray, fps: np.ndarray, joined: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch | None:
        starts = _heads(bucket)
        sizes = np.diff(np.append(starts, len(bucket)))
        more = np.repeat(sizes > 1, sizes)
        if not more.any():
            return None
        node, fps, bucket, joined = node[more], fps[more], bucket[more], joined[more]
        held_sets = [s for s, k in zip(sets, more.tolist(), strict=True) if k] if similar else []

        def same(a: int, b: int) -> bool:
            return alike(held_sets[a], held_sets[b], similar)

        root = linked(np.unpackbits(fps, axis=1), _heads(bucket), radius, same if similar else None, joined)
        far = root != np.arange(len(root))
        ends = node[root[far]], node[far]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    sets: list[np.ndarray] = []
    rows = size = 0

    def closed(to: int | None) -> Iterator[pa.RecordBatch]:
        """Flush the rows up to `to`, those of whole buckets."""
        nonlocal held, sets, rows, size
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = len(whole[0]) if to is None else to
        if cut and (out := flush(*(x[:cut] for x in whole), sets[:cut])) is not None:
            yield out
        held, sets, rows = [tuple(x[cut:] for x in whole)], sets[cut:], len(whole[0]) - cut
        size = sum(s.nbytes for s in sets)

    for batch in batches:
        if not batch.num_rows:
            continue
        fps = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        joined = batch.column(4).to_numpy(zero_copy_only=False) if similar else np.zeros(batch.num_rows, bool)
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), fps, joined))
        rows += batch.num_rows
        if similar:
            new = [np.frombuffer(s, "<u8") for s in batch.column(3).to_pylist()]
            sets += new
            size += sum(s.nbytes for s in new)
        if rows >= ROWS_AT_ONCE or size >= SET_BYTES:
            last = held[-1][0][-1]  # the last bucket may go on
            yield from closed(sum(int(np.searchsorted(x[0], last)) for x in held))
    if rows:
        yield from closed(None)


def _in_cells(rows: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """For hot buckets: rows with `bucket`, a hash of the key and of two parts: a key of n parts (parts: key, n) has a cell for each pair of parts, and a
    row goes to all cells of its own part, so any two rows of a key meet and no task gets a whole hot key. Keys missing in parts have one."""
    dealt = rows.join(parts, key, "left").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return dealt.withColumn("bucket", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))


def links(keyed: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all node pairs within radius that share a bucket, from (bucket, node, fp)."""
    hot = stored(keyed.groupBy("bucket").count().where(F.col("count") > HOT_BUCKET).select("bucket", F.ceil(2 * F.col("count") / HOT_BUCKET).cast("int").alias("n")), "hot-buckets")
    if not hot.isEmpty():
        keyed = _in_cells(keyed.withColumnRenamed("bucket", "key"), "key", hot.withColumnRenamed("bucket", "key")).select("bucket", "node", "fp")
    return keyed.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(lambda batches: _stars(batches, radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node it reaches.

    Each step is stored, which cuts lineage; joins are between stored tables, so that a node of very many edges is a skewed
    key on a plain shuffle, which adaptive execution splits (its other side has one row a node).
    """
    state = lambda stars: stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    now = stored(edges.select("a", "b").distinct(), "edges")
    before = state(now)
    while True:
        # large star: what is larger than a node moves to the node's smallest neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = stored(now.join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct(), "large-stars")
        # small star: a node and its smaller neighbours move to the smallest of them
        low = stored(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "low")
        small = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
        after = stored(small.union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), "edges")
        used_up(now, least, large, low)
        if (found := state(after)) == before:
            return after.select(F.col("b").alias("node"), F.col("a").alias("component"))
        now, before = after, found


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over links, itself included.

    Links are between fingerprints, each of which is a node of its own: rows with a null id link others (and have a component, null only where
    nothing in it has an id), and rows of one id with different fingerprints are joined only by links.
    """
    fps = stored(fingerprints(docs, width), "fingerprints")
    known = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "nodes")  # stored, so a node keeps its number
    found = components(links(_keyed(known.select("node", "fp"), exact_tables(radius)), radius))
    # stored, so that a component or a fingerprint of very many rows is a skewed key of a plain join
    placed = stored(known.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("component")), "placed")
    firsts = stored(placed.groupBy("component").agg(F.min("least").alias("component_id")), "firsts")
    classes = stored(placed.join(firsts, "component").select("fp", "component_id"), "classes")
    used_up(placed, firsts)
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, digest, fp, blocks) of every row: digest stands for the set of shingles, fp is its fingerprint, blocks are the
    bucket keys, each made of BLOCK_ROWS smallest hashes."""

    def sketch(text: bytes) -> tuple[bytes, bytes, bytes]:
        import xxhash

        h = shingle_set(text, width)
        least = np.full(len(_FLIP), ~np.uint64(0))
        for at in range(0, len(h), SHINGLES_AT_ONCE):
            part = h[at : at + SHINGLES_AT_ONCE]
            np.minimum(least, ((part[None] ^ _FLIP[:, None]) * _TIMES[:, None]).min(1), out=least)
        block = np.arange(BLOCKS, dtype=np.uint64)
        for column in least.reshape(BLOCKS, BLOCK_ROWS).T:
            block = _mixed(block ^ column, 1)
        return xxhash.xxh3_128_digest(h.tobytes()), majority(h, COPY_WORDS), block.tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 8 << 20):
            made = zip(*map(sketch, texts_of(batch.column(2))), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in made)], names=["doc_id", "text_hash", "digest", "fp", "blocks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(work, "doc_id long, text_hash long, digest binary, fp binary, blocks binary")


def _shared_blocks(known: DataFrame) -> DataFrame:
    """(bucket, node, fp) of the blocks that two nodes or more share. Blocks travel without fingerprints first, as most have one node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BLOCKS))], names=["bucket", "node"])

    rows = stored(known.select("node", "blocks").mapInArrow(work, "bucket long, node long"), "blocks")
    shared = stored(rows.groupBy("bucket").count().where("count > 1").select("bucket"), "shared-blocks")
    met = stored(rows.join(shared, "bucket"), "met")
    used_up(rows, shared)
    return met.join(known.select("node", "fp"), "node").select("bucket", "node", "fp")


def _confirmed(groups: DataFrame, known: DataFrame, docs: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """Edges (a, b), a < b, between nodes of a group, whose components are those of all its pairs with similar sets."""
    members = groups.union(groups.select(F.col("component").alias("node"), "component")).distinct()
    heads = known.join(members, "node").select("node", "component", F.col("head.doc_id").alias("h_doc"), F.col("head.text_hash").alias("h_text"), "fp")
    heads = stored(heads, "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = texts.join(heads, texts.doc_id.eqNullSafe(heads.h_doc) & (texts.text_hash == heads.h_text)).select("node", "component", "fp", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 8 << 20):
            sets = pa.array([shingle_set(t, width).tobytes() for t in texts_of(batch.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], names=["node", "component", "fp", "hashes"])

    # equal rows give a node more than once
    sets = stored(found.mapInArrow(work, "node long, component long, fp binary, hashes binary").dropDuplicates(["node"]), "shingle-sets")
    hot = stored(sets.groupBy("component").agg(F.sum(F.length("hashes") + NODE_BYTES).alias("bytes")).where(F.col("bytes") > HOT_BYTES).select("component"), "hot-groups")
    columns = ["bucket", "node", "fp", "hashes", "joined"]
    cells = sets.withColumns({"bucket": F.col("component"), "joined": F.lit(False)})
    edges = None
    if not hot.isEmpty():
        parted, edges = _hot_cells(stored(sets.join(hot, "component"), "hot-sets"), similar)
        cells = cells.join(hot, "component", "left_anti").select(*columns).union(parted.select(*columns))
    dealt = cells.select(*columns).repartition("bucket").sortWithinPartitions("bucket", "joined", "node")
    found = dealt.mapInArrow(lambda batches: _stars(batches, COPY_RADIUS, similar), "a long, b long")
    return found if edges is None else found.union(edges)


def _hot_cells(sets: DataFrame, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """For groups (node, component, fp, hashes) that are too large for one task: their cells (bucket, node, fp, hashes, joined) and edges (a, b).

    A large group is mostly copies of one text. The node nearest to the majority of all its fingerprints is its hub; every node is compared
    with it in one narrow pass, and those that are linked to it are joined. Only the others must meet all: parts of them meet each other
    and parts of the joined ones, which meet nobody else. So the work is in proportion to the group, but for what isn't linked to its hub.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1).astype(np.int64) * 2 - 1
            group = batch.column(0).to_numpy(zero_copy_only=False)
            for g in np.unique(group).tolist():
                sums[g] = sums.get(g, 0) + bits[group == g].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["component", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[g] = sums.get(g, 0) + np.frombuffer(x, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.packbits(x > 0).tobytes() for x in sums.values()], pa.binary())], names=["component", "middle"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64))], names=["component", "node", "far"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 8 << 20):
            linked_ = [alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), similar) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(linked_, pa.bool_())], names=["node", "component", "fp", "hashes", "hub", "joined"])

    # a task sends one sum of bits a group, however many nodes it has seen
    middles = sets.select("component", "fp").mapInArrow(counted, "component long, sums binary").repartition("component").mapInArrow(added, "component long, middle binary")
    far = sets.join(stored(middles, "middles"), "component").select("component", "node", "fp", "middle").mapInArrow(measured, "component long, node long, far long")
    hubs = far.groupBy("component").agg(F.min(F.struct("far", "node")).alias("h")).select(F.col("h.node").alias("hub"))
    hubs = stored(hubs.join(sets, F.col("hub") == F.col("node")).select("component", "hub", F.col("hashes").alias("hub_hashes")), "hubs")
    rows = sets.join(hubs, "component").select("node", "component", "fp", "hashes", "hub", "hub_hashes")
    rows = stored(rows.mapInArrow(compared, "node long, component long, fp binary, hashes binary, hub long, joined boolean"), "hub-links")
    edges = rows.where("joined AND node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    parts = lambda which: F.ceil(2 * F.sum(F.when(which, F.length("hashes") + NODE_BYTES).otherwise(0)) / HOT_BYTES).cast("int")
    sizes = stored(rows.groupBy("component").agg(parts(F.col("joined")).alias("of_joined"), parts(~F.col("joined")).alias("of_others")), "hot-parts")
    placed = rows.join(sizes, "component")
    own = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    # cells: a part of the others with a part of the joined ones, or with a part of the others
    some = lambda n, of: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), of)).otherwise(F.array().cast("array<struct<i:int,j:int,two:boolean>>"))
    cell = lambda i, j, two: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(two).alias("two"))
    mine = own(F.col("of_others"))
    others = F.concat(some("of_joined", lambda j: cell(mine, j, True)), some("of_others", lambda i: cell(F.least(mine, i), F.greatest(mine, i), False)))
    joined = some("of_others", lambda i: cell(i, own(F.col("of_joined")), True))
    each = placed.withColumn("cell", F.explode(F.when(F.col("joined"), joined).otherwise(others)))
    return each.withColumn("bucket", F.xxhash64("component", "cell.i", "cell.j", "cell.two")), edges


def near_copies(docs: DataFrame, width: int = 5, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc_id, text_hash, component_id, first) of every row of docs (doc_id, text): the smallest doc_id that it reaches over links between
    texts whose sets of distinct shingles are similar (null where no row of the component has an id), and whether it is its component's
    first row. Rows that are equal in id and text are all first or none."""
    made = stored(sketches(docs, width), "sketches")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("head")
    known = stored(made.groupBy("digest").agg(head, F.first("fp").alias("fp"), F.first("blocks").alias("blocks")).withColumn("node", F.monotonically_increasing_id()), "sets")
    groups = components(links(_shared_blocks(known), COPY_RADIUS))
    found = components(_confirmed(groups, known, docs, width, similar))
    classes = stored(known.join(found, "node", "left").select("digest", "head", F.coalesce("component", "node").alias("component")), "classes")
    firsts = stored(classes.groupBy("component").agg(F.min("head").alias("first")), "firsts")
    rows = made.select("doc_id", "text_hash", "digest").join(stored(classes.join(firsts, "component").select("digest", "first"), "first-rows"), "digest")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return rows.select("doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), is_first.alias("first"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
