"""Exact dedup by skew-safe combining.

1. Locally: the partial aggregation on (digest, salt, whole text) folds the copies inside each task to one row before any row is shuffled; the
   salt comes from the task's number, so it is the same for all of them.
2. Salted: what the tasks leave of one text meets in up to `salts` places, so a text that every task holds is not one task's work.
3. Globally: at most `salts` winners of a text meet and the largest id of them stays.

Every stage groups by the digest and the whole text, so texts that only share a digest stay apart. The members then find
their winner by digest. Where one digest has several texts (a collision), those rows are joined by the text as well.

Defined cases: a null text counts as empty; a null id loses to any other; of rows with equal text and equal id exactly one
is kept; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Parts into which the copies of one text are dealt before the last merge.
SALTS = 16
#: Groups with more than one in HOT_SHARE of all rows are joined by broadcast; there can't be more than HOT_SHARE of them.
HOT_SHARE = 1000


def combine(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """(_d, _t, _id) -> one row per distinct text: _d, _t, keep_id, group_size."""
    salted = (
        docs.withColumn("_salt", F.spark_partition_id() % salts)
        .groupBy("_d", "_salt", "_t")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy("_d", "_t").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all columns of docs: the same combining, which carries the row of the largest id along, so nothing is joined.

    A null text stays null unless an equal (empty) text has a larger id; of rows that repeat id and text one stays.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    best = F.struct(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("null"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(others)))
    rows = docs.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_d"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), best.alias("_best"), (F.spark_partition_id() % salts).alias("_salt"))
    salted = rows.groupBy("_d", "_salt", "_t").agg(F.max("_best").alias("_best"))
    whole = salted.groupBy("_d", "_t").agg(F.max("_best").alias("_best"))
    by = {id_col: F.col("_best.id"), text_col: F.when(~F.col("_best.null"), F.col("_t"))} | {c: F.col(f"_best.c{k}") for k, c in enumerate(others)}
    return whole.select(*(by[c].alias(c) for c in docs.columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=None) -> DataFrame:
    """One row per input row: <id_col>, keep_id, group_size, kept, text_sha256.

    digest: a function of the text column that gives the grouping digest (SHA-256 by default); any function is right, since
    texts are compared in full.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.withColumn("_sha", F.sha2("_t", 256)).withColumn("_d", digest(F.col("_t")) if digest else F.col("_sha"))
    members = durable(rows.select("_id", "_sha", "_d", F.monotonically_increasing_id().alias("_row")), "dedup-members")
    winners = durable(combine(rows.select("_d", "_t", "_id"), salts).select("_d", F.sha2("_t", 256).alias("_wsha"), F.length("_t").alias("_len"), "keep_id", "group_size"), "dedup-winners")

    collided = winners.groupBy("_d").count().where("count > 1").select("_d")
    if collided.isEmpty():
        found = _find(members, winners)
    else:
        collided = durable(collided, "dedup-collided")
        found = _find(members.join(collided, "_d", "left_anti"), winners.join(collided, "_d", "left_anti"))
        odd = rows.join(collided, "_d", "left_semi").withColumn("_row", -1 - F.monotonically_increasing_id())
        found = found.unionByName(odd.join(combine(odd.select("_d", "_t", "_id"), salts), ["_d", "_t"]).select(*found.columns))
    found = durable(found, "dedup-found")
    # rows that repeat id and text: the one of smallest number stays. They are counted in each task first
    stays = F.col("_id").eqNullSafe(F.col("keep_id"))
    repeated = found.where(stays).groupBy("_sha").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_first")).where("n > 1").select("_sha", "_first")
    repeated = durable(repeated, "dedup-repeated")
    if not repeated.isEmpty():
        found = found.join(repeated, "_sha", "left")
        stays = stays & F.coalesce(F.col("_row") == F.col("_first"), F.lit(True))
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", stays.alias("kept"), F.col("_sha").alias("text_sha256"))


def _find(members: DataFrame, winners: DataFrame) -> DataFrame:
    """Members with their winner, by digest; hot digests by a broadcast of at most HOT_SHARE rows, the others by a shuffle."""
    total = members.count()
    big = F.col("group_size") * HOT_SHARE > total
    hot = winners.where(big).select("_d", F.col("keep_id").alias("_hk"), F.col("group_size").alias("_hn"))
    cold = winners.where(~big).select(F.col("_d").alias("_key"), F.col("keep_id").alias("_ck"), F.col("group_size").alias("_cn"))
    is_hot = F.col("_hn").isNotNull()
    # hot rows are dealt by their numbers, and find nothing on the cold side: a digest never starts with #
    dealt = members.join(F.broadcast(hot), "_d", "left").withColumn("_key", F.when(is_hot, F.concat(F.lit("#"), F.col("_row").cast("string"))).otherwise(F.col("_d")))
    return dealt.join(cold, "_key", "left").select(
        "_id", "_sha", "_row", F.when(is_hot, F.col("_hk")).otherwise(F.col("_ck")).alias("keep_id"), F.when(is_hot, F.col("_hn")).otherwise(F.col("_cn")).alias("group_size")
    )
