"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only.

Every document has a hash. A source takes each document `full` times, and once more those whose hash is below the source's
threshold. The threshold is found by nested histograms: tokens by source and hash bucket, the bucket in which the budget
runs out, then the same inside that bucket alone. Nothing is sorted but the buckets; the sizes table is narrow and written once.

Defined cases: a null text has no words; a null source is a source of its own, the last one; equal rows share their hash and are
taken together; sources without words have target 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, word_count

#: Bits of the hash at each level, and levels: 36 bits part the documents of a source into single ones.
BITS, LEVELS = 12, 3
#: A document may be taken so many times.
MOST = 3


def targets(by_source: DataFrame, most: int = MOST) -> DataFrame:
    """(_s, source_size) -> adds target. Weights 1, 2, 3, repeating in code point order, null last; no target above most times the size.

    One row per source, so the windows over all rows hold as many rows as there are sources.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.col("_s").asc_nulls_last()))
    w = by_source.withColumn("_w", ((place - 1) % 3 + 1).cast("double")).withColumn("_cap", (F.col("source_size") * most).cast("double")).withColumn("_total", total.cast("double"))
    # by cap over weight, the sources that stop at their cap come first; the rest share what these leave
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_s").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    w = w.withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap")).withColumn("_at", F.row_number().over(order))
    level = F.min_by("_level", F.when(F.col("_fits"), F.col("_at"))).over(Window.partitionBy())
    return w.withColumn("_share", level * F.col("_w")).select("_s", "source_size", F.when(F.col("_share") <= F.col("_cap"), F.col("_share")).otherwise(F.col("_cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, keep: tuple = ()) -> DataFrame:
    """One row per input row: <id_col>, size, source_size, target, taken, copies (taken = copies * size), and the columns named in keep."""
    measured = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_s"), word_count(F.col(text_col)).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 64 - BITS * LEVELS).alias("_h"), *(F.col(c).alias(f"_keep_{c}") for c in keep),
    )
    sizes = durable(measured.select("_id", "_s", "size", "_h"), "mix-sizes")
    goal = durable(targets(sizes.groupBy("_s").agg(F.sum("size").alias("source_size")), most), "mix-targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("_full", full).withColumn("_left", F.col("target") - F.col("_full") * F.col("source_size"))

    found = goal.where("_left > 0").select("_s", F.lit(0).cast("long").alias("_prefix"), F.col("_left").alias("_left"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        state = found.select(F.col("_s").alias("_fs"), "_prefix", "_left")
        within = sizes.join(state, sizes["_s"].eqNullSafe(F.col("_fs")) & (F.shiftright("_h", shift + BITS) == F.col("_prefix")))
        hist = within.groupBy("_s", "_left", F.shiftright("_h", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"))
        line = Window.partitionBy("_s").orderBy("_bucket")
        hist = hist.withColumn("_upto", F.sum("_sum").over(line))
        # the first bucket in which the budget runs out
        ends = hist.where(F.col("_upto") >= F.col("_left")).withColumn("_n", F.row_number().over(line)).where("_n = 1")
        found = durable(ends.select("_s", F.col("_bucket").alias("_prefix"), (F.col("_left") - F.col("_upto") + F.col("_sum")).alias("_left"), F.col("_sum").alias("_cell")), "mix-level")
    # the last cell is taken if that comes nearer to the budget
    ends = found.select(F.col("_s").alias("_fs"), (F.col("_prefix") + F.when(F.abs(F.col("_cell") - F.col("_left")) < F.col("_left"), 1).otherwise(0)).alias("_below"))
    goal = durable(goal.join(ends, goal["_s"].eqNullSafe(ends["_fs"]), "left").select(F.col("_s").alias("_gs"), "source_size", "target", "_full", "_below"), "mix-thresholds")

    copies = F.col("_full") + F.when(F.col("_h") < F.col("_below"), 1).otherwise(0)
    # columns to keep are read again with the text, rather than shuffled or written twice
    rows = measured if keep else sizes
    return rows.join(goal, rows["_s"].eqNullSafe(goal["_gs"])).select(
        F.col("_id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *(F.col(f"_keep_{c}").alias(c) for c in keep)
    )
