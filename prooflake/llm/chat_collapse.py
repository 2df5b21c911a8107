"""Chat formatting with cumulative-snapshot collapse: of logged conversations that extend one another only the longest stay.

Each turn is hashed with its position; running combinations of these hashes are 128-bit hashes of every turn prefix. A
conversation whose whole hash is a proper prefix's hash of another is dropped by an anti-join, and of equal ones the smallest
id stays. The turns that remain are rendered one row each, so no conversation is gathered in one value or task: positions and
prefix hashes come from a two-level scan over groups of TURN_GROUP turn numbers. A group of over HOT_ROWS rows (many rows of one turn number,
or without one) is split further by turn, role and the first bits of the content's hash, which keeps the order.

Rows: turns are ordered by turn (null first), then role (null first) and a hash of the content, so ties and repeated rows have a defined order; a
null role renders as "unknown", a null text as empty, yet both differ from the real value when conversations are compared. A null
conv_id is one conversation. Empty tables give empty results; other columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prooflake.llm.common import stored, table

TURN_GROUP, HOT_ROWS = 256, 100_000
START, END = "<|", "|>"


def hashed(turns: DataFrame) -> DataFrame:
    """turns with c1, c2, a 128-bit hash of role and text, and grp, the group of a turn: a struct whose order is that of the turns."""
    content = lambda seed: F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    rows = turns.select("conv_id", "turn", "role", "text")
    rows = rows.withColumns({"g": F.coalesce(F.floor(F.col("turn") / TURN_GROUP), F.lit(-(1 << 62))), "c1": content(1), "c2": content(2)})
    hot = rows.groupBy("conv_id", "g").count().where(F.col("count") > HOT_ROWS)
    hot = stored(hot.select(F.col("conv_id").alias("h_conv"), F.col("g").alias("h_g"), F.lit(True).alias("hot")), "hot-turns")
    if hot.isEmpty():
        rows = rows.withColumn("hot", F.lit(False))
    else:
        rows = rows.join(hot, rows.conv_id.eqNullSafe(hot.h_conv) & (rows.g == hot.h_g), "left").drop("h_conv", "h_g")
    parts = [F.when(F.col("hot"), c).alias(name) for name, c in (("turn", F.col("turn")), ("role", F.col("role")), ("bits", F.shiftright("c1", 56)))]
    return rows.withColumn("grp", F.struct("g", *parts)).drop("g", "hot")


def _placed(rows: DataFrame, bases: DataFrame) -> DataFrame:
    """rows with position: those before their group (bases: c, g, base), and the place in it. The join and the window share their keys."""
    inside = Window.partitionBy("conv_id", "grp").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "c1", "c2")))
    joined = rows.join(bases, rows.conv_id.eqNullSafe(bases.c) & (rows.grp == bases.g))
    return joined.withColumn("position", F.col("base") + F.row_number().over(inside)).drop("c", "g", "base")


def prefixes(narrow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From hashed rows without texts: (conv_id, position, h1, h2), the hashes of the turns up to there, and (c, g, base), the number of
    turns before each group."""
    before = Window.partitionBy("conv_id").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    counts = narrow.groupBy("conv_id", "grp").count()
    bases = stored(counts.select(F.col("conv_id").alias("c"), F.col("grp").alias("g"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "turn-groups")
    turn_hash = lambda seed: F.xxhash64(F.lit(seed), "position", "c1", "c2")
    placed = _placed(narrow, bases).select("conv_id", "grp", "position", turn_hash(1).alias("t1"), turn_hash(2).alias("t2"))
    sums = placed.groupBy("conv_id", "grp").agg(*(F.bit_xor(t).alias(t) for t in ("t1", "t2")))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("grp").alias("g"), *(F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(b) for t, b in (("t1", "b1"), ("t2", "b2"))))
    running = Window.partitionBy("conv_id", "grp").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.join(sums, placed.conv_id.eqNullSafe(sums.c) & (placed.grp == sums.g))
    return joined.select("conv_id", "position", *(F.col(b).bitwiseXOR(F.bit_xor(t).over(running)).alias(h) for t, b, h in (("t1", "b1", "h1"), ("t2", "b2", "h2")))), bases


def maximal(prefixed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no proper prefix of another, one of each set of equal ones."""
    whole = prefixed.groupBy("conv_id").agg(F.max(F.struct("position", "h1", "h2")).alias("end")).select("conv_id", F.col("end.position").alias("n_turns"), "end.h1", "end.h2")
    # one row per different whole conversation; nulls count as larger than any id
    single = whole.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    ends = whole.select(F.col("conv_id").alias("c"), "n_turns")
    inner = prefixed.join(ends, prefixed.conv_id.eqNullSafe(ends.c)).where("position < n_turns").groupBy(F.col("position").alias("n_turns"), "h1", "h2").agg(F.count("*").alias("n"))
    return single.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def rendered(role: Column, text: Column) -> Column:
    """One turn of the chat format. Marks inside a text are broken up, so they can't be mistaken for the format's own."""
    clean = lambda c: F.replace(c, F.lit(START), F.lit("< |"))
    return F.concat(F.lit(START), clean(F.coalesce(role, F.lit("unknown"))), F.lit(END + "\n"), clean(F.coalesce(text, F.lit(""))), F.lit("\n" + START + "end" + END + "\n"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, position, n_turns, rendered) of every turn of the maximal conversations. Texts are shuffled once, for those alone."""
    rows = hashed(turns)
    found, bases = prefixes(rows.drop("text"))
    kept = maximal(stored(found, "prefixes")).select(F.col("conv_id").alias("k"), "n_turns")
    groups = bases.join(kept, bases.c.eqNullSafe(kept.k)).drop("k")
    return _placed(rows, groups).select("conv_id", "position", "n_turns", rendered(F.col("role"), F.col("text")).alias("rendered"))


def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST) AS position
  FROM conversations
), whole AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY position) AS turns FROM placed GROUP BY conv_id
), single AS (
  SELECT min(conv_id) AS conv_id, n_turns, turns FROM whole GROUP BY n_turns, turns
), kept AS (
  SELECT conv_id, n_turns FROM single a
  WHERE NOT EXISTS (SELECT 1 FROM single b WHERE b.n_turns > a.n_turns AND b.turns[1] = a.turns[1] AND list_slice(b.turns, 1, a.n_turns) = a.turns)
)
SELECT p.conv_id, p.position, k.n_turns,
       '<|' || replace(coalesce(p.role, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(p.text, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS rendered
FROM placed p JOIN kept k ON p.conv_id = k.conv_id
"""
