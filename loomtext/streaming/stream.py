"""The per-document steps on a stream: they keep no state, so the same columns work on readStream; usage totals use a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.output import hook_envelope
from ..plans import text_pipeline


def documents(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of text files: path, text."""
    return spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def process(stream: DataFrame, **options) -> DataFrame:
    return text_pipeline.run(stream, **options)


def hooks(prompts: DataFrame) -> DataFrame:
    """JSON lines {"prompt": ...} (column value) -> the envelopes of those that are flagged; malformed or empty prompts give nothing."""
    asked = prompts.select(F.btrim(F.from_json("value", "prompt string")["prompt"], F.lit(" \t\r\n")).alias("text")).where("text <> ''")
    return text_pipeline.screened(asked).select(hook_envelope(F.col("found")).alias("value")).where("value is not null")


def hourly_usage(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Tokens by hour of a stream of usage records, with late ones up to the watermark."""
    timed = records.withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("count"), F.sum("in").alias("in"), F.sum("out").alias("out"), F.sum("saved").alias("saved"))
