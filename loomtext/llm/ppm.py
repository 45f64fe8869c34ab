"""LM scoring by prediction by partial matching over bytes, beside a word-unigram base.

A text is its words (ASCII letters lower-cased), one space between them, then one end. The model is the byte-context trie of
order ORDER, pretrained on the training documents: at a context of n counts over d distinct symbols, symbol s has probability
(2 c(s) - 1) / 2n and the escape to the next shorter context d / 2n (method D); symbols seen in the longer context are excluded
from n and d of the shorter one. Below order 0 the symbols never seen share the rest evenly.

The trie is never in one place. Tasks count (context, symbol) strings of ORDER + 1 symbols; these are dealt by the last three
symbols of the context, so every node down from depth three is in the same partition as its suffixes; the nodes above are a table of
the counts of strings of three symbols, at most 258^3 whatever the corpus (some hundred thousand in text). A partition comes sorted by these three
symbols and is worked on in stretches of whole subtrees of about STRETCH strings, so a task holds no more than that or one subtree. It
writes the log probability of each string, those that only unseen documents hold included. Texts are then scored by looking
their strings up (see lexicon: the commonest, at most GRAMS, from a broadcast hash table of 24 bytes each at most; all others by a join).
Python workers live on from stage to stage, so what a step leaves free goes back to the system, and no step holds a whole batch in Python.

Defined cases: a null text has no words, so only its end is scored; a null id counts as an empty one for the split; equal rows
are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon
from .common import durable

#: Symbols of a context. Symbols are START, the bytes plus one, END.
ORDER = 5
BITS, START, END, SYMBOLS = 9, 0, 257, 258
#: Symbols that can be predicted: the bytes and the end.
CHOICES = 257
#: At most so many strings are broadcast.
GRAMS = 2_000_000
#: Positions worked on at once.
CHUNK = 1_000_000
HELD = 300_000
#: Counts given out at once.
ROWS = 100_000
#: Strings of the trie worked on at once, about.
STRETCH = 200_000


def words(text) -> list[bytes]:
    return text.encode().lower().split() if text else []


def symbols(texts: list[bytes]) -> np.ndarray:
    """START times ORDER, the bytes plus one, END: for each text."""
    out = np.zeros(sum(map(len, texts)) + (ORDER + 1) * len(texts), np.uint16)
    at = 0
    for t in texts:
        at += ORDER
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        out[at : at + len(t)] += 1
        at += len(t)
        out[at] = END
        at += 1
    return out


def grams(s: np.ndarray) -> np.ndarray:
    """The string that ends at each symbol but START, in order."""
    g = np.zeros(len(s) - ORDER, np.int64)
    for k in range(ORDER + 1):
        g <<= BITS
        g |= s[k : len(s) - ORDER + k]
    return g[s[ORDER:] != START]


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, keys ascending; counts: n or n x m."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first, axis=0)


def chunks(batches, *columns):
    """Lists of the columns' values, cut so that the text (the first column) of each has about CHUNK characters."""
    for b in batches:
        sizes, start, size = pc.fill_null(pc.utf8_length(b.column(columns[0])), 0).to_pylist(), 0, 0
        for k, n in enumerate(sizes):
            size += n
            if size >= CHUNK or k == len(sizes) - 1:
                yield [b.column(c).slice(start, k + 1 - start).to_pylist() for c in columns]
                start, size = k + 1, 0


def trim() -> None:
    """Give free memory back to the system, where the C library can."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def count_grams(batches):
    """(text, train) -> gram, n_train, n_other: once for each distinct gram, as long as they fit."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for texts, train in chunks(batches, 0, 1):
        found = []
        for want in (True, False):
            some = [b" ".join(words(t)) for t, x in zip(texts, train, strict=True) if x == want]
            if some:
                found.append(grams(symbols(some)) * 2 + want)
        k, n = np.unique(np.concatenate(found), return_counts=True)
        keys, sums = merged(np.concatenate([keys, k]), np.concatenate([sums, n]))
        if len(keys) > 2_000_000:
            yield from split_counts(keys, sums)
            keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield from split_counts(keys, sums)
    del keys, sums
    trim()


def split_counts(keys, sums):
    for low in range(0, len(keys), ROWS):
        k, n = keys[low : low + ROWS], sums[low : low + ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(k >> 1), pa.array(n * (k & 1)), pa.array(n * (1 - (k & 1)))], names=["gram", "n_train", "n_other"])


def locate(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the key is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Top:
    """The nodes of depth two and less: counts of strings of three symbols in the training documents, keys ascending."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(np.float64)
        self.pairs = np.zeros((SYMBOLS, SYMBOLS))
        np.add.at(self.pairs, (keys >> BITS & (1 << BITS) - 1, keys & (1 << BITS) - 1), self.counts)


def log_probabilities(gram: np.ndarray, n_train: np.ndarray, top: Top) -> np.ndarray:
    """log10 P(symbol | context) of each gram; gram: ascending, all that share the last three context symbols of any of them."""
    seen = gram[n_train > 0]
    c_seen = n_train[n_train > 0].astype(np.float64)
    mask = lambda k: (1 << BITS * (k + 1)) - 1  # noqa: E731  of a context of k symbols and a symbol
    pairs, counts = {2: top.keys}, {2: top.counts}
    for k in range(3, ORDER + 1):
        pairs[k], counts[k] = merged(seen & mask(k), c_seen)
    top = top.pairs

    def count(k, g):
        """Of each gram's string of order k."""
        if k >= 2:
            at, ok = locate(pairs[k], g & mask(k))
            return np.where(ok, counts[k][at] if len(counts[k]) else 0.0, 0.0)
        if k == 1:
            return top[g >> BITS & (1 << BITS) - 1, g & (1 << BITS) - 1].astype(np.float64)
        return zero[g & (1 << BITS) - 1]

    zero = top.sum(0).astype(np.float64)
    log = np.zeros(len(gram))
    open_ = np.ones(len(gram), bool)  # not yet predicted
    excluded = np.zeros((len(gram), ORDER + 1, 2))  # at [k]: counts and number of the symbols that the context of k + 1 has seen
    size = np.zeros((len(gram), ORDER + 2, 2))
    for k in range(ORDER, -1, -1):
        if k >= 2:
            ctx, first = np.unique(pairs[k] >> BITS, return_index=True)
            n = np.add.reduceat(counts[k], first) if len(first) else np.zeros(0)
            d = np.diff(np.append(first, len(pairs[k]))).astype(np.float64)
            less = np.add.reduceat(count(k - 1, pairs[k]), first) if len(first) else np.zeros(0)
            at, ok = locate(ctx, gram >> BITS & (1 << BITS * k) - 1)
            if len(ctx):
                size[:, k] = np.stack([n[at], d[at]], 1) * ok[:, None]
                excluded[:, k - 1] = np.stack([less[at], d[at]], 1) * ok[:, None]
        elif k == 1:
            c = gram >> BITS & (1 << BITS) - 1
            size[:, 1] = np.stack([top.sum(1)[c], (top > 0).sum(1)[c]], 1)
            excluded[:, 0] = np.stack([((top > 0) * zero).sum(1)[c], (top > 0).sum(1)[c]], 1)
        else:
            size[:, 0] = zero.sum(), (zero > 0).sum()
    for k in range(ORDER, -1, -1):
        n, d = size[:, k, 0], size[:, k, 1]
        if k < ORDER:
            n, d = n - excluded[:, k, 0], d - excluded[:, k, 1]
        c = count(k, gram)
        here = open_ & (c > 0)
        log[here] += np.log10((2 * c[here] - 1) / (2 * n)[here])
        open_ &= ~here
        left = open_ & (d > 0)
        log[left] += np.log10(d[left] / (2 * n)[left])
    log[open_] -= np.log10(CHOICES - size[open_, 0, 1])
    return log


class Table:
    """A hash table of distinct int64 keys from 0, looked up by whole arrays: keys and values by bucket, and where each bucket starts."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length())
        home = self.home(keys)
        self.start = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(home, minlength=1 << self.bits), out=self.start[1:])
        order = np.argsort(home, kind="stable")
        self.keys, self.values = np.append(keys[order], np.int64(-1)), np.append(values[order], 0.0)  # the last: of no key

    def home(self, keys):
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where missing), and where they are missing."""
        home = self.home(keys)
        at, end = self.start[home], self.start[home + 1]
        at[at == end] = len(self.keys) - 1
        lost = self.keys[at] != keys
        left = np.flatnonzero(lost & (at + 1 < end))
        while len(left):  # on in the bucket
            at[left] += 1
            hit = self.keys[at[left]] == keys[left]
            lost[left[hit]] = False
            left = left[~hit]
            left = left[at[left] + 1 < end[left]]
        out = self.values[at]
        out[lost] = 0
        return out, lost


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", common_words: int = lexicon.LIMIT, common_grams: int = GRAMS) -> DataFrame:
    """One row per input row: <id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score. train: a boolean column, true for documents to learn from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), train.alias("train"))
    texts = rows.select("text", "train")

    # words of the training documents
    kind = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count_words(batches):
        def add(counts, b):
            for t in b.column(0).to_pylist():
                counts.update(words(t))

        yield from lexicon.flushed(Counter(), batches, add, HELD, kind)

    vocabulary = durable(texts.where("train").select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    ends = texts.where("train").count()
    sums = vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    below = total + 0.1 * (distinct + 1)
    base = lambda c: float(np.log10((c + 0.1) / below))
    known_words = spark.sparkContext.broadcast({bytes(r["word"]): base(r["n"]) for r in lexicon.common(vocabulary, "n", common_words).toLocalIterator()})

    # strings of all documents, with the counts of the training documents
    counted = texts.mapInArrow(count_grams, "gram long, n_train long, n_other long")
    counted = durable(counted.groupBy("gram").agg(F.sum("n_train").alias("n_train"), F.sum("n_other").alias("n_other")), "lm-grams")
    three = counted.where("n_train > 0").groupBy(F.col("gram").bitwiseAND((1 << 3 * BITS) - 1).alias("g")).agg(F.sum("n_train").alias("n")).orderBy("g").toArrow()  # at most SYMBOLS cubed
    top = spark.sparkContext.broadcast(Top(three.column("g").to_numpy(), three.column("n").to_numpy()))

    def trie(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= STRETCH:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last subtree may go on
                if cut:
                    yield estimated(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = len(t) - cut
        if size:
            yield estimated(pa.Table.from_batches(held))
        held.clear()
        trim()

    def estimated(t: pa.Table) -> pa.RecordBatch:
        g, n, o = (t.column(c).to_numpy() for c in ("gram", "n_train", "n_other"))
        order = np.argsort(g)
        g, n, o = g[order], n[order], o[order]
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n + o), pa.array(log_probabilities(g, n, top.value))], names=["gram", "n", "logp"])

    dealt = counted.withColumn("key", F.shiftright("gram", BITS).bitwiseAND((1 << 3 * BITS) - 1)).repartition("key").sortWithinPartitions("key")
    model = durable(dealt.mapInArrow(trie, "gram long, n long, logp double"), "lm-model")
    most = lexicon.common(model, "n", common_grams).select("gram", "logp").toArrow()
    known_grams = spark.sparkContext.broadcast(Table(most.column("gram").to_numpy(), most.column("logp").to_numpy()))
    del most

    def look_up(batches):
        get, lookup = known_words.value.get, known_grams.value
        end = base(ends)
        for b in batches:
            low = 0
            for (some,) in chunks([b], 1):
                ids, train = b.column(0).slice(low, len(some)), b.column(2).slice(low, len(some))
                low += len(some)
                n_tokens, n_known, base_sum = (np.zeros(len(some), d) for d in (np.int64, np.int64, np.float64))
                joined, rare_words = [], []
                for k, t in enumerate(some):
                    w = words(t)
                    joined.append(b" ".join(w))
                    got = list(map(get, w))
                    n_tokens[k] = len(w) + 1
                    if None in got:
                        odd = Counter(x for x, v in zip(w, got, strict=True) if v is None)
                        got = [v for v in got if v is not None]
                        rare_words.append([{"key": x, "n": n} for x, n in odd.items()])
                    else:
                        rare_words.append([])
                    n_known[k], base_sum[k] = len(got) + (ends > 0), sum(got) + end
                g = grams(symbols(joined))
                own = np.repeat(np.arange(len(joined)), [len(x) + 1 for x in joined])
                value, lost = lookup.get(g)
                logp = np.bincount(own, weights=value, minlength=len(joined))
                by: list = [Counter() for _ in joined]
                for k, x in zip(own[lost].tolist(), g[lost].tolist(), strict=True):
                    by[k][x] += 1
                rare_grams = [[{"key": x, "n": n} for x, n in c.items()] for c in by]
                yield pa.RecordBatch.from_arrays(
                    [ids, train, pa.array(n_tokens), pa.array(n_known), pa.array(base_sum), pa.array(logp), pa.array(rare_words, pa.list_(pa.struct([("key", pa.binary()), ("n", pa.int64())]))), pa.array(rare_grams, pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))],
                    names=["id", "train", "n_tokens", "n_known", "base", "logp", "rare_words", "rare_grams"],
                )

    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("train boolean, n_tokens long, n_known long, base double, logp double, rare_words array<struct<key:binary,n:long>>, rare_grams array<struct<key:long,n:long>>").fields])
    found = durable(rows.mapInArrow(look_up, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    c = F.coalesce(F.col("count"), F.lit(0))
    odd = found.select("row", F.explode("rare_words").alias("r")).select("row", F.col("r.key").alias("word"), F.col("r.n").alias("times")).join(vocabulary.withColumnRenamed("n", "count"), "word", "left")
    odd = odd.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10((c + 0.1) / below)).alias("b"))
    rest = found.select("row", F.explode("rare_grams").alias("r")).select("row", F.col("r.key").alias("gram"), F.col("r.n").alias("times")).join(model.select("gram", F.col("logp").alias("lp")), "gram")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("lp")).alias("g"))
    zero = F.lit(0)
    return found.join(odd, "row", "left").join(rest, "row", "left").select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("logp") + F.coalesce("g", zero)).alias("score"),
    )
