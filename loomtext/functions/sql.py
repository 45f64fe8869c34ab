"""Names for Spark SQL: scalar functions and table functions over one text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.rank import places, rank
from ..sources.surfaces import html_surfaces_of

#: What counts as white space, as in the columns (functions/text.py).
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _python_sentences(text: str) -> list[str]:
    import re

    parts = re.split("(?<=[.!?])(?=['\"’]?[\\t\\n\\f\\r ]+[A-Z'\"“])", text or "")
    return [x for s in parts if (x := s.strip(BLANKS))]


def _python_words(sentence: str) -> list[str]:
    import re

    kept = ("".join(c for c in w if c == "-" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd") for w in re.split(f"[{BLANKS}]+", sentence.lower()))
    return [w for k in kept if (w := re.sub("-+", "-", k).strip("-"))]


class Sentences:
    def eval(self, text: str):
        for i, s in enumerate(_python_sentences(text)):
            yield i, s


class Ranked:
    def eval(self, text: str, algorithm: str):
        s = _python_sentences(text)
        scores = rank([_python_words(x) for x in s], algorithm)["scores"]
        for i, (x, p, r) in enumerate(zip(s, scores.tolist(), places(scores).tolist(), strict=True)):
            yield i, x, p, r


class Surfaces:
    def eval(self, html: str):
        for i, (source, text) in enumerate(html_surfaces_of(html)):
            yield i, source, text


def register(spark: SparkSession) -> None:
    """loom_summary(text, algorithm, n); tables loom_sentences(text), loom_ranked(text, algorithm), loom_surfaces(html)."""

    @F.pandas_udf("string")
    def summary(text: pd.Series, algorithm: pd.Series, n: pd.Series) -> pd.Series:
        """n = 0 stands for 5, as everywhere."""
        out = []
        for t, a, k in zip(text, algorithm, n, strict=True):
            s = _python_sentences(t)
            scores = rank([_python_words(x) for x in s], a, False)["scores"]
            out.append(" ".join(x for x, r in zip(s, places(scores), strict=True) if r <= (k or 5)))
        return pd.Series(out)

    spark.udf.register("loom_summary", summary)
    spark.udtf.register("loom_sentences", F.udtf(Sentences, returnType="sent_idx int, sentence string"))
    spark.udtf.register("loom_ranked", F.udtf(Ranked, returnType="sent_idx int, sentence string, score double, rank int"))
    spark.udtf.register("loom_surfaces", F.udtf(Surfaces, returnType="surface_idx int, source string, text string"))
