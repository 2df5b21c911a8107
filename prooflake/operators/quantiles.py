"""Exact quantiles by selection: no group's values meet in one task.

A double becomes a whole number whose order is that of the doubles (sign, exponent, mantissa). Numbers are counted by their upper 16 bits; the bin
that holds a wanted rank is counted again by the next 16, and so on, until the bins that are left hold few rows, or a single value each. So a pass
is one aggregation with at most 65,536 counters a group and rank, at any number of rows, and at most four passes lead to the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prooflake.storage import stored

#: Rows of one bin that may be put in order in a task; larger bins are counted once more.
SMALL = 10_000
#: Bits that are left below a bin in each pass.
SHIFTS = (48, 32, 16, 0)


def image(value: Column) -> Column:
    """A long in the order of the doubles: NaN is largest, as Spark has it, and the two zeros are equal."""
    v = value.cast("double")
    a = F.abs(v)
    two = lambda k: F.pow(F.lit(2.0), k)
    near = F.floor(F.log2(a)).cast("int")  # may be off by one next to a power of two
    e = F.when(two(near) > a, near - 1).when(two(near + 1) <= a, near + 1).otherwise(near)
    unit = F.lit(1 << 52).cast("long")
    normal = (e + 1023).cast("long") * unit + ((a / two(e) - 1) * F.lit(float(1 << 52))).cast("long")
    tiny = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    size = F.when(a == 0, F.lit(0).cast("long")).when(a == F.lit(float("inf")), F.lit(2047 << 52).cast("long")).when(a < F.lit(2.0**-1022), tiny).otherwise(normal)
    return F.when(F.isnan(v), F.lit((1 << 63) - 1).cast("long")).when(v < 0, -size).otherwise(size)


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by..., q): the quantiles of a column's values in each group, linear between neighbours; nulls don't count, groups of nulls are left out."""
    groups, kept = [f"_g{k}" for k in range(len(by))], [f"_t{k}" for k in range(len(by))]
    narrow = rows.select(*(F.col(b).alias(g) for b, g in zip(by, groups, strict=True)), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    narrow = stored(narrow.withColumn("_image", image(F.col("_v"))), "quantile-values")
    targets, above = None, None
    for shift in SHIFTS:
        bin_ = F.shiftright("_image", shift).alias("_bin")
        upper = F.lit(0).cast("long") if above is None else F.shiftright("_image", above)
        inside = narrow.select(*groups, upper.alias("_upper"), bin_)
        if targets is not None:  # only the bins that hold a wanted rank
            wanted = targets.select(*kept, F.col("_at").alias("_in")).distinct()
            inside = inside.join(wanted, _same(groups, kept) & (F.col("_upper") == F.col("_in"))).select(*groups, "_upper", "_bin")
        counts = inside.groupBy(*groups, "_upper", "_bin").agg(F.count("*").alias("_m"))
        bins = Window.partitionBy(*groups, "_upper")
        before = F.coalesce(F.sum("_m").over(bins.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumns({"_before": before, "_n": F.sum("_m").over(bins)})
        if targets is None:
            place = F.struct(*(F.struct(F.lit(k).alias("k"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("at")).alias(f"s{k}") for k, s in enumerate(shares)))
            sizes = counts.select(*(F.col(g).alias(t) for g, t in zip(groups, kept, strict=True)), "_n").distinct().withColumn("_s", F.array(*(place[f"s{k}"] for k in range(len(shares)))))
            ranks = sizes.select(*kept, F.explode("_s").alias("s")).select(*kept, F.col("s.k").alias("_k"), F.col("s.at").alias("_place"))
            ranks = ranks.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))))
            targets = ranks.select(*kept, "_k", "_place", F.col("_rank").alias("_whole"), "_rank", F.lit(0).cast("long").alias("_at"))
        met = _same(groups, kept) & (F.col("_upper") == F.col("_at")) & (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_m"))
        targets = targets.drop("_m").join(counts, met).select(*kept, "_k", "_place", "_whole", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_bin").alias("_at"), "_m")
        targets = stored(targets, "quantile-bins")
        above = shift
        if (targets.agg(F.max("_m")).first()[0] or 0) <= SMALL:
            break
    bins = targets.select(*(F.col(t).alias(f"{t}b") for t in kept), F.col("_at").alias("_in")).distinct()
    held = narrow.select(*groups, "_v", "_image", F.shiftright("_image", above).alias("_bin")).join(bins, _same(groups, [f"{t}b" for t in kept]) & (F.col("_bin") == F.col("_in")))
    if above:
        held = held.select(*groups, "_bin", "_v", (F.row_number().over(Window.partitionBy(*groups, "_bin").orderBy("_image")) - 1).alias("_r"))
        met = F.col("_r") == F.col("_rank")
    else:  # a bin is one value, however often it stands there
        held, met = held.groupBy(*groups, "_bin").agg(F.first("_v").alias("_v")), F.lit(True)
    found = targets.join(held, _same(groups, kept) & (F.col("_bin") == F.col("_at")) & met)
    low, high = F.min(F.struct("_whole", "_v"))["_v"], F.max(F.struct("_whole", "_v"))["_v"]
    each = found.groupBy(*kept, "_k", "_place").agg(low.alias("_low"), high.alias("_high"))
    part = F.col("_place") - F.floor("_place")
    between = F.when(part == 0, F.col("_low")).otherwise((1 - part) * F.col("_low") + part * F.col("_high"))
    each = each.select(*kept, F.struct("_k", between.alias("_q")).alias("_s"))
    whole = each.groupBy(*kept).agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["_q"]).alias("q"))
    return whole.where(F.size("q") > 0).select(*(F.col(t).alias(b) for b, t in zip(by, kept, strict=True)), "q")
