"""Prefix trie of conversations by partition refinement: one class at first, split by turn after turn until a single sequence is left.

Turns travel as a digest and a length; texts are never shuffled. Conversations whose sequences of turns are equal are counted as one sequence (its
smallest id stands for it), so copies don't keep a class together. All sequences start in the root's class. A pass takes the next
turns of the classes that still hold several sequences, twice as many as the pass before, and splits every class turn by turn: the key of a sequence at a
depth is its class and the running combination of its turns' digests since the class was made. A node is known by its smallest member and its
depth. A class with one sequence is retired: the rest of its turns is a chain of nodes that needs no grouping. So the number of passes
grows with the logarithm of the longest prefix that two different sequences share, and a turn is read by one pass at most.

Folding back needs no passes: whether a sequence ends in a leaf, and what the nodes that it stands for save from a depth on, are summed over the members of each
class. Places in a conversation come from two-level running sums, so a conversation of a third of all rows is no task's work. A group of
equal conversations is hashed from packed runs of ids, which range-partitioned tasks have sorted (a SHA-256 reads its bytes in order).

Rows: turns are ordered by turn (null first), then role, then the digest of role and text, so ties have a defined order; repeated rows are turns of their
own. A null role or text is empty, which equals an empty one. Rows without a conv_id belong to no conversation and are left out. `%` has the sign of the
id, as in SQL. Two prefixes are equal if two 64-bit combinations of SHA-256 digests and depths are. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prooflake.llm.common import running, stored, table

FAMILY, MOST_SHARED = 5, 8
#: Turns of the first pass; each pass takes twice as many as the one before.
FIRST_TURNS = 8
#: Characters of a packed run of ids.
PACKED = 1 << 20
BATCH_ROWS = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, bytes) of every turn, places from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return running(rows.where("conv_id IS NOT NULL"), order, {"place": F.lit(1)}, by=["conv_id"]).select("conv_id", "place", "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len) of every conversation and (conv_id, d, digest, bytes) of its rebuilt turns, d from 1: the first turns of its family's
    first conversation, then its own behind as many."""
    sizes = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "trie-sizes")
    plan = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MOST_SHARED + 1)).alias("h"))
    of_base = sizes.select(F.col("conv_id").alias("b_id"), F.col("n").alias("b_n"))
    plan = plan.join(of_base, F.col("base") == F.col("b_id"), "left").withColumn("shared", F.least("h", F.coalesce("b_n", F.lit(0))))
    plan = stored(plan.select("conv_id", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-plan")
    heads = turns.where(F.col("place") < MOST_SHARED).select(F.col("conv_id").alias("h_id"), "place", "digest", "bytes")
    given = plan.join(heads, (F.col("base") == F.col("h_id")) & (F.col("place") < F.col("shared"))).select("conv_id", (F.col("place") + 1).alias("d"), "digest", "bytes")
    own = turns.join(plan.select(F.col("conv_id").alias("p_id"), "h", "shared"), F.col("conv_id") == F.col("p_id")).where("place >= h")
    own = own.select("conv_id", (F.col("shared") + F.col("place") - F.col("h") + 1).alias("d"), "digest", "bytes")
    return plan.select("conv_id", "len"), stored(given.union(own), "trie-turns")


def _marks(depth: Column, digest: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), depth, digest) for seed in (1, 2)]


def sequences(lens: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, len, weight) of the different sequences, and (rep, conv_id) of every conversation."""
    m1, m2 = _marks(F.col("d"), F.col("digest"))
    whole = turns.groupBy(F.col("conv_id").alias("w_id")).agg(F.bit_xor(m1).alias("x1"), F.bit_xor(m2).alias("x2"))
    zero = F.lit(0).cast("long")
    every = lens.join(whole, F.col("conv_id") == F.col("w_id"), "left").select("conv_id", "len", F.coalesce("x1", zero).alias("x1"), F.coalesce("x2", zero).alias("x2"))
    every = stored(every, "trie-wholes")
    groups = stored(every.groupBy("len", "x1", "x2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "trie-sequences")
    return groups.select("rep", "len", "weight"), every.join(groups, ["len", "x1", "x2"]).select("rep", "conv_id")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (rep, conv_id) as (rep, first, ids): decimal ids, joined by commas."""
    rep, ids, size = None, [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([int(ids[0])], pa.int64()), pa.array([",".join(ids)], pa.string())], names=["rep", "first", "ids"])

    for batch in batches:
        for given, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (given != rep or size > PACKED):
                yield made()
                ids, size = [], 0
            rep = given
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield made()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rep, sha, done = None, None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["rep", "ends_sha256"])

    for batch in batches:
        for given, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if sha is None or given != rep:
                if sha is not None:
                    done.append((rep, sha.hexdigest()))
                rep, sha = given, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if len(done) >= BATCH_ROWS:
            yield made()
            done = []
    if sha is not None:
        done.append((rep, sha.hexdigest()))
    if done:
        yield made()


def ends(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256): the hash of each sequence's conversations in numerical order."""
    runs = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_packed, "rep long, first long, ids string")
    return runs.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(_hashed, "rep long, ends_sha256 string")


#: c is in class `node` at depth d; what is known of the class goes along.
MEMBER = ["c", "d", "node", "n_convs", "n_seqs", "longest", "bytes", "len", "weight"]


def refine(seqs: DataFrame, turns: DataFrame) -> DataFrame:
    """MEMBER rows of every sequence (rep, len, weight) down to the first class that it has to itself, or to its end.

    turns (c, d, digest, bytes) are those of the sequences.
    """
    top = seqs.agg(F.min("rep").alias("node"), F.sum("weight").alias("n_convs"), F.count("*").alias("n_seqs"), F.max("len").alias("longest"))
    zero = F.lit(0).cast("long")
    root = seqs.select(F.col("rep").alias("c"), zero.alias("d"), "len", "weight", zero.alias("bytes")).crossJoin(F.broadcast(top)).select(*MEMBER)
    found = [stored(root, "trie-root")]
    low, step = 0, FIRST_TURNS
    active = found[0].where("n_seqs > 1 AND len > 0").select("c", F.col("node").alias("class"), "len", "weight")
    while not active.isEmpty():
        high = low + step
        inside = Window.partitionBy("c").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = turns.where((F.col("d") > low) & (F.col("d") <= high)).join(active, "c")
        m1, m2 = _marks(F.col("d"), F.col("digest"))
        keyed = stored(rows.select("c", "class", "d", "bytes", "len", "weight", F.bit_xor(m1).over(inside).alias("p1"), F.bit_xor(m2).over(inside).alias("p2")), "trie-keys")
        key = ["class", "d", "p1", "p2"]
        split = stored(keyed.groupBy(*key).agg(F.min("c").alias("node"), F.sum("weight").alias("n_convs"), F.count("*").alias("n_seqs"), F.max("len").alias("longest")), "trie-classes")
        single = F.min(F.when(F.col("n_seqs") == 1, F.col("d"))).over(Window.partitionBy("c"))
        split_rows = keyed.join(split, key).withColumn("alone", single).where("alone IS NULL OR d <= alone")
        found.append(stored(split_rows.select(*MEMBER), "trie-members"))
        active = found[-1].where((F.col("d") == high) & (F.col("n_seqs") > 1) & (F.col("len") > high)).select("c", F.col("node").alias("class"), "len", "weight")
        low, step = high, step * 2
    return reduce(DataFrame.union, found)


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    lens, turns = rebuilt(turns_of(conversations))
    seqs, members = sequences(lens, turns)
    hashes = stored(ends(members), "trie-ends")
    reps = seqs.select(F.col("rep").alias("c"), "len", "weight")
    own = stored(turns.withColumnRenamed("conv_id", "c").join(reps, "c"), "trie-distinct")
    held = refine(seqs, own.select("c", "d", "digest", "bytes"))

    # a retired sequence's other turns are a chain
    alone = held.where("n_seqs = 1").select("c", F.col("d").alias("since"))
    chain = stored(own.join(alone, "c").where("d > since").select("c", "d", "bytes", "len", "weight"), "trie-chains")
    copied = chain.where("weight > 1").select("c", "d", ((F.col("weight") - 1) * F.col("bytes")).alias("saves"))
    totals = stored(copied.groupBy("c").agg(F.sum("saves").alias("total")), "trie-totals")
    before = running(copied, [F.col("c"), F.col("d")], {"before": F.col("saves")}, by=["c"]).join(totals, "c")
    saved = before.select(F.col("c").alias("s_c"), F.col("d").alias("s_d"), (F.col("total") - F.col("before")).alias("saved"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    tails = chain.join(saved, (F.col("c") == F.col("s_c")) & (F.col("d") == F.col("s_d")), "left")
    tails = tails.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("c").alias("parent_conv_id"), F.col("weight").alias("n_convs"), F.when(F.col("d") < F.col("len"), one).otherwise(zero).alias("n_children"), one.alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"))

    # fold back: every sequence gives its share to the classes that hold it
    path = Window.partitionBy("c").orderBy("d")
    below = Window.partitionBy("c").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    saves = F.when(F.col("c") == F.col("node"), (F.col("n_convs") - 1) * F.col("bytes")).otherwise(zero)
    leaf = (F.col("n_seqs") == 1) | ((F.col("d") == F.col("len")) & (F.col("longest") == F.col("len")))
    shares = held.join(totals, "c", "left").withColumns({"share": F.sum(saves).over(below) + F.coalesce("total", zero), "leaf": F.max(leaf).over(Window.partitionBy("c")), "parent": F.lag("node").over(path)})
    shares = stored(shares.select(*MEMBER, "share", "leaf", "parent"), "trie-shares")
    sums = shares.groupBy(F.col("node").alias("n_id"), F.col("d").alias("n_d")).agg(F.sum("share").alias("saved_tokens"), F.count_if("leaf").alias("n_leaves"))
    nodes = shares.where("c = node")
    below_ = nodes.where("d > 0").groupBy(F.col("parent").alias("p_id"), (F.col("d") - 1).alias("p_d")).agg(F.count("*").alias("classes"))
    joined = nodes.join(sums, (F.col("node") == F.col("n_id")) & (F.col("d") == F.col("n_d"))).join(below_, (F.col("node") == F.col("p_id")) & (F.col("d") == F.col("p_d")), "left")
    children = F.when(F.col("n_seqs") == 1, F.when(F.col("len") > F.col("d"), one).otherwise(zero)).otherwise(F.coalesce("classes", zero))
    inner = joined.select(F.col("node").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", children.alias("n_children"), "n_leaves", "saved_tokens")

    ended = shares.where("d = len").select(F.col("c").alias("rep"), F.col("node").alias("e_id"), F.col("d").alias("e_d"))
    ended = ended.union(chain.where("d = len").select("c", "c", "d")).join(hashes, "rep").drop("rep")
    every = inner.unionByName(tails).join(ended, (F.col("conv_id") == F.col("e_id")) & (F.col("depth") == F.col("e_d")), "left")
    return every.select(*inner.columns, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
