"""The usage log: JSON lines of counts, never of content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.output import TOOL, json_number

RECORD = "ts string, in int, out int, saved int"
# Fixed value
NOTICE = "{tool}: usage stats now logged to {path} (counts only — no content). Disable with [stats] enabled = false in the settings; clear by resetting the log"


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Blank and malformed lines are skipped; a missing log is empty."""
    try:
        return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORD)


def append_usage(records: DataFrame, path: str, enabled: bool = True) -> str | None:
    """Append counts unless that is switched off. The first time, the notice to show: what is logged, where, and how to stop it."""
    if not enabled:
        return None
    spark = records.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    first = not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    records.select("ts", "in", "out", "saved").write.mode("append").json(path)
    return NOTICE.format(tool=TOOL, path=path) if first else None


def reset_usage(spark: SparkSession, path: str) -> None:
    """Remove the log, if there is one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _totals():
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    return [F.count(F.lit(1)).alias("count"), n("in"), n("out"), n("saved")]


def _percent(df: DataFrame) -> DataFrame:
    return df.withColumn("percent", F.when(F.col("in") > 0, F.col("saved") / F.col("in") * 100).otherwise(0.0))


def totals(records: DataFrame) -> DataFrame:
    """count, in, out, saved, percent."""
    return _percent(records.agg(*_totals()))


def daily(records: DataFrame) -> DataFrame:
    """The same by date: the first ten characters of ts, whatever its time zone; shorter ones are skipped."""
    return _percent(records.where("length(ts) >= 10").groupBy(F.substring("ts", 1, 10).alias("date")).agg(*_totals())).orderBy("date")


COLUMNS = ("invocations", "in", "out", "saved", "reduction")


def totals_text(sums: DataFrame) -> DataFrame:
    """totals() as five lines: text."""
    percent = F.format_string("%.1f%%", F.col("percent"))
    rows = [("invocations:", F.col("count").cast("string")), ("tokens in:", F.col("in").cast("string")), ("tokens out:", F.col("out").cast("string")), ("tokens saved:", F.col("saved").cast("string")), ("reduction:", percent)]
    return sums.select(F.concat(*(F.concat(F.lit(f"{name:<15}"), c, F.lit("\n")) for name, c in rows)).alias("text"))


def as_json(sums: DataFrame, many: bool = False) -> DataFrame:
    """totals(), or daily() if many, as indented JSON: text. Days are few, so they are one row."""
    names = [c for c in sums.columns]
    field = lambda c: F.when(F.lit(c == "date"), F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))).otherwise(json_number(F.col(c)) if c == "percent" else F.col(c).cast("string"))

    def block(indent: str):
        lines = F.concat_ws(",\n", *(F.concat(F.lit(f'{indent}  "{c}": '), field(c)) for c in names))
        return F.concat(F.lit(indent + "{\n"), lines, F.lit(f"\n{indent}}}"))

    if not many:
        return sums.select(F.concat(block(""), F.lit("\n")).alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("date", block("  ").alias("b"))))
    rows = sums.agg(listed.alias("l"))
    return rows.select(F.when(F.size("l") > 0, F.concat(F.lit("[\n"), F.concat_ws(",\n", F.transform("l", lambda x: x["b"])), F.lit("\n]\n"))).otherwise("[]\n").alias("text"))


def daily_table(days: DataFrame) -> DataFrame:
    """daily() as a table, its columns as wide as they must be and two spaces apart: text. Days are few, so they are one row."""
    cells = [F.col("date"), *(F.col(c).cast("string") for c in ("count", "in", "out", "saved")), F.format_string("%.1f%%", F.col("percent"))]
    head = ("date", *COLUMNS)
    rows = days.agg(F.array_sort(F.collect_list(F.array(*cells))).alias("l"))
    width = lambda k: F.greatest(F.lit(len(head[k])), F.coalesce(F.array_max(F.transform("l", lambda r: F.length(r[k]))), F.lit(0))) + 2
    line = lambda of: F.concat(*(F.rpad(of(k), width(k), " ") for k in range(len(head) - 1)), of(len(head) - 1), F.lit("\n"))
    return rows.select(F.concat(line(lambda k: F.lit(head[k])), F.concat_ws("", F.transform("l", lambda r: line(lambda k: r[k])))).alias("text"))
