"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame) -> DataFrame:
    """(u, v) -> node, root: every node that has a link to another, and the smallest node it reaches. Links may repeat or run either way.

    Each step is two aggregations and two joins over the links, whose number never grows; a step is written to the shared folder, and the
    number of steps grows with the logarithm of the longest path.
    """
    e = links.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()
    e = durable(e, "links")
    sign = lambda t: tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    was = sign(e)
    while was[0]:
        both = e.union(e.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = durable(small.union(least).distinct(), "links")
        now = sign(e)
        if now == was:
            break
        was = now
    return e.toDF("node", "root")
