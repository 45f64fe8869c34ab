"""Language ID by string kernels.

The kernel of two texts is the number of character n-grams (one to three characters, lower case) that both have, divided by the
root of the product of their own numbers: a blended spectrum of presences. Nyström landmarks stand for the feature space, and
one-versus-rest kernel ridge regression is solved on a sample of labelled texts: FIT_ROWS of them and SAMPLE_CHARS characters of each
at most. The sample is drawn by hash thresholds, from a count of each language, so nothing is ranked. The feature space is the
landmarks' n-grams; of more than GRAMS, those that most landmarks hold. Every text is scored whole: batches of presence
vectors times the landmark matrix (at most GRAMS x LANDMARKS numbers, broadcast), times the coefficients.

Defined cases: a text that is null or has no letter is `und` with score 0; rows with a null label are predicted but not learnt
from; without any labelled training row all texts are `und`; equal texts get equal predictions, and are one text of the sample; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

#: Labelled texts that the classifier is fitted on, at most, and the characters of each; every language has an equal share of the texts.
FIT_ROWS, SAMPLE_CHARS = 2400, 20_000
#: Nyström landmarks, at most, dealt evenly over the languages.
LANDMARKS = 160
#: Longest n-gram, and the ridge.
SPECTRUM, RIDGE = 3, 0.05
#: Texts in one matrix product.
BATCH = 64
#: Features at most.
GRAMS = 1 << 16
UND = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: str) -> np.ndarray:
    """The text's n-grams as 64-bit numbers, repeats included: up to three code points of 21 bits are exact."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out, g = [c], c
    for k in range(1, SPECTRUM):
        g = (g[:-1] << np.uint64(21)) | c[k:]
        out.append(g)
    return np.concatenate(out)


class Spectrum:
    """Presence vectors over a fixed set of n-grams."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(8, int(8 * len(keys)).bit_length())
        self.slots = [np.full(1 << self.bits, -1, np.int32) for _ in range(2)]
        first = self.home(keys)
        self.slots[0][first] = np.arange(len(keys))
        second = np.flatnonzero(self.slots[0][first] != np.arange(len(keys)))  # n-grams whose place another has taken
        self.rest = keys[second]
        self.rest_at = second

    def home(self, g):
        return (g * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def presence(self, text: str, row: np.ndarray) -> int:
        """Fills the row; the number of the text's distinct n-grams, those beside the features included."""
        g = np.sort(ngrams(text))
        g = g[np.append(True, g[1:] != g[:-1])]
        distinct = len(g)
        at = self.slots[0][self.home(g)]
        hit = at >= 0
        at, g2 = at[hit], g[hit]
        same = self.keys[at] == g2
        row[at[same]] = 1
        if len(self.rest):
            other = g2[~same]
            place = np.minimum(np.searchsorted(self.rest, other), len(self.rest) - 1)
            ok = self.rest[place] == other
            row[self.rest_at[place[ok]]] = 1
        return distinct


class Classifier:
    """Fitted on (text, label) pairs; predicts (label, score)."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int = LANDMARKS):
        self.languages = sorted(set(labels))
        by = {lang: [t for t, x in zip(texts, labels, strict=True) if x == lang] for lang in self.languages}
        each = max(1, landmarks // len(self.languages))
        marks = [t for lang in self.languages for t in by[lang][:each]]
        grams, held = np.unique(np.concatenate([np.unique(ngrams(t)) for t in marks]), return_counts=True)
        self.spectrum = Spectrum(np.sort(grams[np.argsort(-held, kind="stable")[:GRAMS]]))
        self.marks = self.unit(marks).T.copy()
        own = self.marks.T @ self.marks
        value, vector = np.linalg.eigh(own.astype(np.float64))
        keep = value > 1e-6 * value[-1]
        root = vector[:, keep] / np.sqrt(value[keep])
        phi = np.concatenate([self.unit(texts[k : k + BATCH]) @ self.marks for k in range(0, len(texts), BATCH)]).astype(np.float64) @ root
        y = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 2.0, 0.0)  # above -1, the value of a text that shares nothing with any landmark
        w = np.linalg.solve(phi.T @ phi + RIDGE * np.eye(phi.shape[1]), phi.T @ y)
        self.coefficients = (root @ w).astype(np.float32)

    def unit(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.spectrum.keys)), np.float32)
        own = np.array([self.spectrum.presence(t, row) for t, row in zip(texts, x, strict=True)], np.float32)
        return x / np.sqrt(own)[:, None]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language of the largest decision value, and that value taken from -1 to 1 to 0 to 1."""
        out = []
        for k in range(0, len(texts), BATCH):
            value = (self.unit(texts[k : k + BATCH]) @ self.marks) @ self.coefficients - 1
            best = value.argmax(1)
            out += [(self.languages[b], float(min(1.0, max(0.0, (v[b] + 1) / 2)))) for b, v in zip(best, value, strict=True)]
        return out


def sample(docs: DataFrame, train, id_col: str, text_col: str, lang_col: str, rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """At most rows (text, label) pairs: of each language about an equal share, the distinct texts of smallest hash, each cut to SAMPLE_CHARS."""
    text = F.col(text_col)
    own = docs.where(train).where(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(F.col(lang_col).alias("l"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("h"), text.alias("t"))
    keys = durable(own.select("l", "h").distinct(), "language-keys")
    found = keys.groupBy("l").count().orderBy(F.desc("count"), "l").limit(rows).collect()  # a row for each language, rows of them at most
    if not found:
        return []
    each = max(1, rows // len(found))
    below = {r["l"]: min(2**63 - 1, 2**63 // r["count"] * (each + 4 * math.isqrt(each) + 4)) for r in found}  # a few more than each are below it, by all odds
    limits = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
    picked = keys.where(F.col("h") <= limits[F.col("l")])
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    picked = picked.withColumn("k", place).where(F.col("k") <= each).select("l", "h")  # of some more than each rows
    texts = own.join(F.broadcast(picked), ["l", "h"]).groupBy("l", "h").agg(F.min(F.substring("t", 1, SAMPLE_CHARS)).alias("t"))
    return [(r["t"], r["l"]) for r in sorted(texts.collect(), key=lambda r: (r["l"], r["h"]))]


def identify(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, keep: tuple = ()) -> DataFrame:
    """One row per input row: <id_col>, lang_pred, score, and the columns named in keep. train: a boolean column, true for rows that may be learnt from."""
    spark = docs.sparkSession
    pairs = sample(docs, train, id_col, text_col, lang_col, rows)
    fitted = spark.sparkContext.broadcast(Classifier([t for t, _ in pairs], [x for _, x in pairs]) if pairs else None)
    asked = docs.select(F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"), F.col(id_col).alias("_id"), *(F.col(c).alias(f"_keep_{c}") for c in keep))

    def predict(batches):
        c = fitted.value
        for b in batches:
            texts, letters = b.column(0).to_pylist(), b.column(1).to_pylist()
            names, scores = [UND] * len(texts), [0.0] * len(texts)
            at = [k for k, ok in enumerate(letters) if ok] if c else []
            for k, (name, s) in zip(at, c.predict([texts[k] for k in at]) if at else [], strict=True):
                names[k], scores[k] = name, s
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[2:], "lang_pred", "score"])

    schema = T.StructType([*asked.schema.fields[2:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return asked.mapInArrow(predict, schema).select(F.col("_id").alias(id_col), "lang_pred", "score", *(F.col(f"_keep_{c}").alias(c) for c in keep))
