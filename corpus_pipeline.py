"""From raw documents to packed training sequences: STAGES, and run() that applies them.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one packed pieces. Stages work on all that the
one before kept, each result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import durable, table
from loomtext.llm.exact_dedup import survivors
from loomtext.llm.language_id import UND, identify
from loomtext.llm.mixing import mix
from loomtext.llm.ngram_join import near_duplicates, without
from loomtext.llm.packing import pack
from loomtext.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Score at which a language's decision value is zero: below it, every one-versus-rest classifier says no.
FLOOR = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows. A document goes that has no letter, or in which the classifier finds no language (a score below FLOOR) and
    whose label isn't the best guess either. A null label becomes the predicted language. Without labelled rows all documents with a letter stay.
    """
    seen = identify(docs, F.lit(True), keep=("text", "lang", "source", "n_chars"))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    guess = F.when(F.col("lang_pred") != UND, F.col("lang_pred"))
    stays = letters & (guess.isNull() | (F.col("score") >= FLOOR) | F.col("lang").eqNullSafe(guess))
    return seen.where(stays).withColumn("lang", F.coalesce("lang", guess)).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; of rows that repeat that too, any one."""
    return survivors(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 of their five-word shingles, the one of smallest doc_id stays (a null one is the smallest; of
    equal ids, the text of smallest digest; of rows that repeat both, any one).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.col("doc_id").alias("a"), F.sha2(text, 256).alias("b"))
    found = durable(near_duplicates(docs.select("text", key.alias("_row")), id_col="_row"), "near-found")
    name = lambda row: F.concat_ws(":", F.coalesce(row["a"].cast("string"), F.lit("")), row["b"])
    dropped = found.where(F.col("_row") != F.col("component_id")).select(name(F.col("_row")).alias("key"))
    repeated = found.groupBy("_row").agg(F.count(F.lit(1)).alias("n"), F.first("component_id").alias("c")).where("n > 1")
    repeated = durable(repeated.select(name(F.col("_row")).alias("key"), (F.col("_row") == F.col("c")).alias("stays")), "near-repeated")
    rows = docs.select(*COLUMNS)
    if repeated.isEmpty():
        return without(rows, durable(dropped, "near-dropped"), name(key))
    once = rows.withColumn("_key", name(key)).join(repeated.where("stays").select(F.col("key").alias("_key")), "_key", "left_semi").dropDuplicates(["_key"])
    return without(rows, durable(dropped.union(repeated.select("key")), "near-dropped"), name(key)).unionByName(once.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    mixed = mix(docs, keep=("text", "lang", "source", "n_chars")).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("source mix", source_mix), ("packing", sequences)]
#: The first stage has no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
