"""ROUGE-1, -2 and -L of two arrays of sentences. n-grams are native; the longest common subsequence is an Arrow kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import vectorised
from ..functions.patterns import let
from ..functions.text import sentences, words


def _prf(hits: Column, n_system: Column, n_reference: Column) -> Column:
    p, r = hits / n_system, hits / n_reference
    some = (n_system > 0) & (n_reference > 0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    zero = F.lit(0.0)
    return F.struct(F.when(some, p).otherwise(zero).alias("precision"), F.when(some, r).otherwise(zero).alias("recall"), F.when(some, f1).otherwise(zero).alias("f1"))


def ngrams(w: Column, n: int) -> Column:
    def of(x):
        at = F.when(F.size(x) >= n, F.sequence(F.lit(1), F.size(x) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat_ws(" ", F.slice(x, i, n)))

    return let(w, of)


def _hits(a: Column, b: Column) -> Column:
    """Size of the two arrays' common multiset: both are sorted as one, and a run of equals in a comes just before b's run of the same."""
    tagged = lambda x, side: F.transform(x, lambda g: F.struct(g.alias("g"), F.lit(side).alias("side")))

    def counted(z):
        def of(starts):
            runs = F.transform(starts, lambda s, k: F.struct(F.get(z, s)["g"].alias("g"), (F.coalesce(F.get(starts, k + 1), F.size(z)) - s).alias("c")))
            after = lambda r, k: F.when(F.get(r, k + 1)["g"] == F.get(r, k)["g"], F.least(F.get(r, k + 1)["c"], F.get(r, k)["c"])).otherwise(0)
            return let(runs, lambda r: F.aggregate(F.transform(r, lambda x, k: after(r, k)), F.lit(0), lambda s, c: s + c))

        first = lambda i: (i == 0) | (F.get(z, i) != F.get(z, i - 1))
        return let(F.filter(F.transform(z, lambda x, i: i), first), of)

    return let(F.array_sort(F.concat(tagged(a, 0), tagged(b, 1))), counted)


def rouge_n(system: Column, reference: Column, n: int) -> Column:
    """struct<precision, recall, f1> of two word arrays; an n-gram counts as often as both have it."""

    def of(z):
        return let(_hits(z["a"], z["b"]).cast("double"), lambda h: _prf(h, F.size(z["a"]), F.size(z["b"])))

    return let(F.struct(ngrams(system, n).alias("a"), ngrams(reference, n).alias("b")), of)


@vectorised("int")
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, a row of the table at a time."""
    out = []
    for x, y in zip(a, b, strict=True):
        ids: dict = {}
        xs, ys = (np.array([ids.setdefault(w, len(ids)) for w in s], np.int64) for s in (x, y))
        row = np.zeros(len(ys) + 1, np.int64)
        for w in xs:
            best = np.maximum(row[1:], np.where(ys == w, row[:-1] + 1, 0))
            row[1:] = np.maximum.accumulate(best)
        out.append(int(row[-1]))
    return pd.Series(out)


def rouge(system: Column, reference: Column) -> Column:
    """struct<rouge1, rouge2, rougel> of two arrays of sentences."""
    a, b = words(F.concat_ws(" ", system)), words(F.concat_ws(" ", reference))
    return F.struct(rouge_n(a, b, 1).alias("rouge1"), rouge_n(a, b, 2).alias("rouge2"), _prf(lcs(a, b).cast("double"), F.size(a), F.size(b)).alias("rougel"))


def paired(systems: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """key, rouge1, rouge2, rougel of the texts of equal key in both tables (columns key, text): a document against the summary that somebody wrote of it."""
    s, r = systems.select(key, sentences("text").alias("_s")), references.select(key, sentences("text").alias("_r"))
    return s.join(r, key).select(key, rouge(F.col("_s"), F.col("_r")).alias("x")).select(key, "x.*")


def report(r: Column) -> Column:
    line = lambda name, x: F.format_string(f"{name}: P=%.4f R=%.4f F1=%.4f", x["precision"], x["recall"], x["f1"])
    return F.concat_ws("\n", line("ROUGE-1", r["rouge1"]), line("ROUGE-2", r["rouge2"]), line("ROUGE-L", r["rougel"]))
