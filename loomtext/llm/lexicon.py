"""Values looked up by key where the keys are too many to broadcast.

A corpus has an unbounded number of distinct keys (words, pieces, byte strings), a few of which make up most of the text. The
`common` keys, at most LIMIT of them, go to every Python worker; what a document holds besides comes back as rows
(row, key, count) that are joined with the full table by a shuffle. Every key is looked up either way, none is dropped.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are broadcast.
LIMIT = 400_000


def common(table: DataFrame, weight: str, limit: int = LIMIT) -> DataFrame:
    """The rows of table with the largest weights, at most limit of them: all above a power of 2**(1/4), so no sort is needed."""
    step = F.floor(F.log2(F.col(weight)) * 4).cast("int")
    found = sorted(((r["b"], r["n"]) for r in table.where(f"{weight} > 0").groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, math.inf
    for b, n in found:
        total += n
        if total > limit:
            break
        least = b
    return table.where(F.col(weight) > 0).where(step >= (F.lit(least) if least != math.inf else F.lit(2**30)))


def flushed(counts: dict, batches, add, most: int, schema: pa.Schema):
    """Call add(counts, batch) for each batch and give out counts as rows (key, its numbers) whenever there are more than most keys."""
    for batch in batches:
        add(counts, batch)
        if len(counts) > most:
            yield rows(counts, schema)
            counts.clear()
    if counts:
        yield rows(counts, schema)


def rows(counts: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), schema.field(0).type), pa.array(counts.values(), schema.field(1).type)], schema=schema)
