"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the sum of all sizes; a target stops at
MOST_PASSES times its source's size and the excess is shared again by weight until none is above. Each source is dealt by a
hash of the row into shards of about SHARD_TOKENS, whose token streams are cut into equal blocks of BLOCK_TOKENS (to a
word, and as near to that as a short shard allows). All shards compete for the mix's blocks by the quotients
claim / (2k + 1); the quotas that result are whole numbers within about half a block of the claims. A seeded permutation of
a shard's blocks then says which of them are taken once more than the rest. A document's taken words are those of its stream that
lie in taken blocks, repeats counted. Where only whole documents can be kept, `copies` is how often: the whole passes of what is taken,
and of the parts that are left as many documents as the parts add up to, along each shard by size.

Everything is DataFrame functions. A source that holds a third of all rows is simply more shards; equal rows (same id, text
and source) are counted first and then dealt one by one, so they fall into many shards too. Sources and tied shards may be many: their
order comes from two-level running sums. Rows: null and empty texts have size 0 and are returned with taken 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prooflake.llm.common import running, stored, table

BLOCK_TOKENS = 64
SHARD_TOKENS = 1 << 15
MOST_PASSES = 3
SEED = 42
#: Divisors tried in one pass over the shards.
PROBES = 32
#: Equal rows that one step lays out; more are laid out in several.
COPIES_AT_ONCE = 4096


def word_count(text: Column) -> Column:
    """Runs of bytes other than space and 0x09-0x0D; a null text has none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows with source and size.

    Each round caps all sources whose share of what is left is above MOST_PASSES times their size, until none is; a round is one
    aggregation over a row per source, and a source once capped stays so, as capping others only raises its share.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.encode("source", "utf-8")]
    weight = (F.pmod(F.col("place"), F.lit(3)) + 1).cast("double")
    room = (F.lit(float(MOST_PASSES)) * F.col("source_size")).alias("room")
    ranked = stored(running(per, order, {"place": F.lit(1)}).select("source", "source_size", weight.alias("weight"), room), "sources")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, open_ = 0.0, None
    while True:
        free = (F.col("weight") * F.lit(level) <= F.col("room")) if level else F.lit(True)
        left = ranked.agg(F.sum(F.when(~free, F.col("room")).otherwise(0.0)), F.sum(F.when(free, F.col("weight")).otherwise(0.0)), F.count_if(free)).first()
        if not left[2] or left[2] == open_:
            break
        open_, level = left[2], (total - left[0]) / left[1]
    target = F.when(F.col("weight") * F.lit(level) <= F.col("room"), F.col("weight") * F.lit(level)).otherwise(F.col("room"))
    return ranked.select("source", "source_size", target.alias("target"))


def sainte_lague(claims: DataFrame, seats: int) -> DataFrame:
    """claims (party columns, claim double) with quota: seats go one by one to the highest claim / (2k + 1), ties in party order.

    With a divisor d a party has floor(claim / d + 1/2) seats. Each pass counts the seats of PROBES divisors; when the
    interval no longer narrows, the seats that are left go to the parties with the highest next quotient.
    """
    won = lambda d: F.floor(F.col("claim") / F.lit(d) + 0.5)
    total = claims.agg(F.sum("claim"), F.count("*")).first()
    if not seats or not total[0]:
        return claims.withColumn("quota", F.lit(0).cast("long"))
    # rounding moves each party by half a seat at most: at low there are more seats than wanted, at high fewer
    low = total[0] / (seats + total[1] / 2 + 1)
    high = total[0] / (seats - total[1] / 2 - 1) if seats > total[1] / 2 + 1 else 2.0 * total[0] + 1.0
    while True:
        step = (high / low) ** (1 / (PROBES + 1))
        probes = [low * step**k for k in range(1, PROBES + 1)]
        probes = sorted({p for p in probes if low < p < high})
        if not probes:
            break
        counts = claims.agg(*(F.sum(won(p)) for p in probes)).first()
        exact = next((p for p, n in zip(probes, counts, strict=True) if n == seats), None)
        if exact is not None:
            return claims.withColumn("quota", won(exact).cast("long"))
        above = [p for p, n in zip(probes, counts, strict=True) if n < seats]
        below = [p for p, n in zip(probes, counts, strict=True) if n > seats]
        low, high = max([low, *below]), min([high, *above])
    # a tie: at `high` a few seats are open, and every party that has another at `low` asks for one
    got = claims.withColumn("quota", won(high).cast("long")).withColumn("more", (won(low) - won(high)).cast("long"))
    party = [c for c in claims.columns if c != "claim"]
    asking = running(got.where("more > 0").select(*party, "more"), [F.col(c) for c in party], {"before": F.col("more")})
    open_seats = seats - (got.agg(F.sum("quota")).first()[0] or 0)
    given = asking.select(*party, F.greatest(F.lit(0), F.least("more", F.lit(open_seats) - F.col("before"))).alias("extra"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in party]
    return got.alias("l").join(given.alias("r"), same, "left").select(*(F.col(f"l.{c}") for c in [*party, "claim"]), (F.col("l.quota") + F.coalesce("r.extra", F.lit(0))).alias("quota"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken, copies) of every row of docs (doc_id, text, source)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", word_count(F.col("text")).alias("size"))
    sizes = stored(rows.groupBy("doc_id", "text_hash", "source", "size").agg(F.count("*").alias("n")), "sizes")
    targets = stored(source_targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size"))), "targets").withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_TOKENS)))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "shards")
    each = sizes.withColumn("k0", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES_AT_ONCE))))
    each = each.withColumn("k1", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES_AT_ONCE), F.col("n") - F.col("k0") * COPIES_AT_ONCE) - 1)))
    each = each.select("doc_id", "text_hash", "source", "size", (F.col("k0") * COPIES_AT_ONCE + F.col("k1")).alias("k"))
    dealt = each.join(F.broadcast(t) if _few(t) else t, F.col("source").eqNullSafe(F.col("t_source")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text_hash", "k"), F.col("shards"))).drop("t_source", "shards")
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    shards = shards.where("shard_size > 0").withColumn("blocks", _blocks(F.col("shard_size")))
    claims = stored(shards.select("source", "shard", (F.col("target") / F.col("source_size") * F.col("blocks")).alias("claim")), "claims")
    seats = round(claims.agg(F.sum("claim")).first()[0] or 0.0)
    quotas = stored(sainte_lague(claims, seats), "quotas").select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "quota")
    # a shard's documents stand in a stream by id; ties (repeated ids) by size, text and number
    stream = Window.partitionBy("source", "shard").orderBy("doc_id", "size", "text_hash", "k").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source", "shard")
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0))).withColumn("shard_size", F.sum("size").over(whole))
    joined = placed.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left")
    quota = F.least(F.coalesce("quota", F.lit(0)), MOST_PASSES * F.col("blocks"))
    laid = joined.withColumn("blocks", _blocks(F.col("shard_size"))).withColumn("passes", F.floor(quota / F.col("blocks"))).withColumn("rest", F.pmod(quota, F.col("blocks")))
    laid = laid.withColumn("turn", F.pmod(F.xxhash64(F.lit(SEED), "source", "shard"), F.lit(1 << 30))).withColumn("jump", _coprime(F.col("blocks"), F.col("turn")))
    edge = lambda block: F.floor(block * F.col("shard_size") / F.col("blocks"))
    holds = lambda word: F.floor(((word + 1) * F.col("blocks") - 1) / F.col("shard_size"))
    first, last = holds(F.col("start")), holds(F.col("start") + F.col("size") - 1)

    def taken_of(so_far: Column, block: Column) -> Column:
        words = F.least(F.col("start") + F.col("size"), edge(block + 1)) - F.greatest(F.col("start"), edge(block))
        place = F.pmod(block * F.col("jump") + F.col("turn"), F.col("blocks"))
        return so_far + words * (F.col("passes") + (place < F.col("rest")).cast("long"))

    taken = F.when(F.col("size") > 0, F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), taken_of)).otherwise(F.lit(0).cast("long"))
    found = laid.withColumn("taken", taken)
    # parts of a pass in millionths, added up along the shard by size: a document is kept once more where the sum passes a whole number
    by_size = Window.partitionBy("source", "shard").orderBy("size", "doc_id", "text_hash", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.greatest("size", F.lit(1))
    part = F.floor(F.pmod(F.col("taken"), size) * 1_000_000 / size)
    found = found.withColumn("part", part).withColumn("sum", F.sum("part").over(by_size) + F.pmod(F.col("turn"), F.lit(1_000_000)))
    more = F.floor(F.col("sum") / 1_000_000) - F.floor((F.col("sum") - F.col("part")) / 1_000_000)
    return found.select("doc_id", "text_hash", "source", "size", "source_size", "target", "taken", (F.floor(F.col("taken") / size) + more).cast("int").alias("copies"))


def _blocks(size: Column) -> Column:
    return F.greatest(F.lit(1), F.round(size / BLOCK_TOKENS)).cast("long")


def _few(df: DataFrame, most: int = 100_000) -> bool:
    """Whether a per-source table is small enough to broadcast; counting stops past the bound."""
    return df.limit(most + 1).count() <= most


def _coprime(blocks: Column, seed: Column) -> Column:
    """A multiplier near the golden section of the block count that shares no divisor with it, so that block * it permutes.

    Of fixed primes around the seeded place at least one doesn't divide the count, as their product exceeds any count.
    """
    primes = [7919, 104729, 1299709, 15485863, 32452843, 49979687, 67867967, 86028121]
    shifted = F.pmod(seed, F.lit(len(primes)))
    return F.element_at(F.filter(F.concat(*(F.when(shifted == k, F.array(*(F.lit(p).cast("long") for p in primes[k:] + primes[:k]))).otherwise(F.array().cast("array<bigint>")) for k in range(len(primes)))), lambda p: F.pmod(blocks, p) != 0), 1)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
