"""Sentence ranking, summaries and outliers.

A document is a row. Sentences and words are native columns; the fixed point is an Arrow kernel, since Catalyst has no iteration.
A kernel holds a document's postings (term, sentence), never its similarity matrix: a step of the fixed point is two passes over the
postings, so a text of n sentences needs memory for its words, not for n x n numbers. Sums run in a fixed order (terms by
code point, then sentences), so scores don't depend on batches, partitions or machines. Ranks go by scores rounded to DIGITS places, so
scores that only rounding errors part are ties, and ties go to the earlier sentence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrow import vectorised
from ..functions.text import n_bytes, reduction, sentence_words, sentences

# Fixed values
EPSILON, STEPS, DAMPING = 1e-4, 1000, 0.85
LEVELS = {"lite": 10, "standard": 5, "aggressive": 3}
OUTLIER = 0.99
DIGITS = 9
ALGORITHMS = ("lexrank", "textrank", "graph", "ensemble")


class Postings:
    """A document's words: for each (term, sentence) pair, terms in code point order, how often; and each sentence's length."""

    def __init__(self, words: list[list[str]]):
        self.n = len(words)
        self.length = np.array([len(s) for s in words], np.int64)
        flat = [w for s in words for w in s]
        number = {w: k for k, w in enumerate(sorted(set(flat)))}
        own = np.repeat(np.arange(self.n), self.length)
        key, self.count = np.unique(np.fromiter((number[w] for w in flat), np.int64, len(flat)) * max(1, self.n) + own, return_counts=True)
        self.term, self.sentence = key // max(1, self.n), key % max(1, self.n)
        self.terms = len(number)
        self.df = np.bincount(self.term, minlength=self.terms)

    def by_sentence(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.sentence, weights=x, minlength=self.n)

    def by_term(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.term, weights=x, minlength=self.terms)


class Cosine:
    """IDF-weighted cosine of all pairs, the diagonal included: with unit rows X, a product with the matrix is X (X' r)."""

    def __init__(self, words: list[list[str]]):
        p = self.p = Postings(words)
        self.idf = np.log(p.n / p.df)
        x = p.count / p.length[p.sentence] * self.idf[p.term]
        norm = np.sqrt(p.by_sentence(x * x))
        self.x = np.divide(x, norm[p.sentence], out=np.zeros_like(x), where=norm[p.sentence] > 0)
        self.own = (norm > 0).astype(np.float64)

    def times(self, r: np.ndarray) -> np.ndarray:
        return self.p.by_sentence(self.x * self.p.by_term(self.x * r[self.p.sentence])[self.p.term])


class Shared:
    """Number of common distinct words; 0 on the diagonal."""

    def __init__(self, words: list[list[str]]):
        p = self.p = Postings(words)
        self.distinct = np.bincount(p.sentence, minlength=p.n)

    def times(self, r: np.ndarray) -> np.ndarray:
        p = self.p
        return np.maximum(p.by_sentence(p.by_term(r[p.sentence])[p.term]) - self.distinct * r, 0)


class Overlap(Shared):
    """Common distinct words by the sum of the logarithms of both lengths; 0 on the diagonal and for lists of one word.

    The divisor depends on the two lengths only, so products go by classes of equal length.
    """

    #: Numbers held at once for terms times lengths.
    ROOM = 4_000_000

    def __init__(self, words: list[list[str]]):
        super().__init__(words)
        p = self.p
        keep = p.length[p.sentence] > 1
        p.term, p.sentence, p.count = p.term[keep], p.sentence[keep], p.count[keep]
        self.lengths, self.kind = np.unique(p.length, return_inverse=True)
        log = np.log(np.maximum(self.lengths, 1))
        divisor = log[:, None] + log[None, :]
        self.weight = np.divide(1.0, divisor, out=np.zeros_like(divisor), where=(self.lengths[:, None] > 1) & (self.lengths[None, :] > 1))

    def times(self, r: np.ndarray) -> np.ndarray:
        p, m = self.p, len(self.lengths)
        out, step = np.zeros(len(p.term)), max(1, self.ROOM // max(1, m))
        for low in range(0, p.terms, step):
            s, e = np.searchsorted(p.term, (low, low + step))
            term, kind = p.term[s:e] - low, self.kind[p.sentence[s:e]]
            sums = np.bincount(term * m + kind, weights=r[p.sentence[s:e]], minlength=min(step, p.terms - low) * m)
            out[s:e] = (sums.reshape(-1, m) @ self.weight)[term, kind]
        own = self.weight[self.kind, self.kind] * self.distinct
        return np.maximum(p.by_sentence(out) - own * r, 0)

    def pairs(self) -> tuple[int, float, float]:
        """Of the pairs above 0: their number (both orders), maximum and mean. One sentence at a time."""
        p, found, top, total = self.p, 0, 0.0, 0.0
        first = np.searchsorted(p.term, np.arange(p.terms + 1))
        for i, own in enumerate(np.split(p.term[np.argsort(p.sentence, kind="stable")], np.cumsum(np.bincount(p.sentence, minlength=p.n))[:-1])):
            if len(own):
                common = np.bincount(np.concatenate([p.sentence[first[t] : first[t + 1]] for t in own]), minlength=p.n).astype(np.float64)
                common[i] = 0
                sim = common * self.weight[self.kind[i], self.kind]
                found, top, total = found + int((sim > 0).sum()), max(top, float(sim.max())), total + float(sim.sum())
        return found, top, total / found if found else 0.0


def fixed_point(m, n: int, damping: float | None) -> tuple[np.ndarray, int, bool]:
    """Stationary distribution of the rows of m divided by their sums (a row of sum 0 is even): scores, steps, whether it settled."""
    sums = m.times(np.ones(n))
    none, share = sums <= 1e-12, np.divide(1.0, sums, out=np.zeros(n), where=sums > 1e-12)
    p = np.full(n, 1 / n)
    for step in range(1, STEPS + 1):
        q = m.times(p * share) + p[none].sum() / n
        if damping is not None:
            q = (1 - damping) / n + damping * q
        moved = np.abs(q - p).sum()
        p = q
        if moved < EPSILON:
            return p, step, True
    return p, STEPS, False


def rank(words: list[list[str]], algorithm: str, statistics: bool = True) -> dict:
    """Scores of the sentences, and what a report says of them (of pairs only where statistics are asked for)."""
    empty = {"scores": np.zeros(0), "iterations": 0, "converged": True, "vocab_size": 0, "idf_min": 0.0, "idf_max": 0.0, "sim_pairs": 0, "sim_nonzero": 0, "sim_max": 0.0, "sim_mean": 0.0}
    n = len(words)
    if not n:
        return empty
    if algorithm == "lexrank":
        m = Cosine(words)
        p, steps, ok = fixed_point(m, n, None)
        return empty | {"scores": p, "iterations": steps, "converged": ok, "vocab_size": len(m.idf), "idf_min": float(m.idf.min(initial=np.inf)) if len(m.idf) else 0.0, "idf_max": float(m.idf.max(initial=0.0))}
    if algorithm in ("textrank", "graph"):
        m = Overlap(words) if algorithm == "textrank" else Shared(words)
        p, steps, ok = fixed_point(m, n, DAMPING)
        found = empty | {"scores": p, "iterations": steps, "converged": ok}
        if algorithm == "textrank" and statistics:
            some, top, mean = m.pairs()
            found |= {"sim_pairs": n * (n - 1), "sim_nonzero": some, "sim_max": top, "sim_mean": mean}
        return found
    if algorithm == "ensemble":
        return empty | {"scores": (rank(words, "lexrank")["scores"] + rank(words, "textrank", False)["scores"]) / 2}
    raise ValueError(f"unknown algorithm {algorithm!r}: valid values are {', '.join(ALGORITHMS)}")


def similarity_matrix(words: list[list[str]], algorithm: str = "lexrank") -> np.ndarray:
    """All similarities of a short document, as a ranking without them never builds them."""
    m = {"lexrank": Cosine, "textrank": Overlap, "graph": Shared}[algorithm](words)
    return np.stack([m.times(row) for row in np.eye(len(words))]) if words else np.zeros((0, 0))


def places(scores: np.ndarray) -> np.ndarray:
    """Rank from 1, ties to the earlier sentence."""
    out = np.empty(len(scores), np.int64)
    out[np.argsort(-np.round(scores, DIGITS), kind="stable")] = np.arange(1, len(scores) + 1)
    return out


INFO = (
    "struct<scores:array<double>,ranks:array<int>,iterations:int,converged:boolean,vocab_size:int,idf_min:double,idf_max:double,"
    "sim_pairs:long,sim_nonzero:long,sim_max:double,sim_mean:double>"
)


def _lists(words) -> list[list[str]]:
    return [list(s) for s in words] if words is not None else []


def ranking(words: Column, algorithm: str = "lexrank", statistics: bool = False) -> Column:
    """Scores, ranks and statistics (those of pairs only where asked for) of a document's array of word lists."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}: valid values are {', '.join(ALGORITHMS)}")

    @F.pandas_udf(INFO)
    def f(docs: pd.Series) -> pd.DataFrame:
        rows = []
        for d in docs:
            r = rank(_lists(d), algorithm, statistics)
            rows.append(r | {"ranks": places(r["scores"]).astype(np.int32)})
        names = ["scores", "ranks", "iterations", "converged", "vocab_size", "idf_min", "idf_max", "sim_pairs", "sim_nonzero", "sim_max", "sim_mean"]
        return pd.DataFrame(rows, columns=names)

    return f(words)


@vectorised("array<double>")
def outlier_scores(docs: pd.Series) -> pd.Series:
    """One less the mean similarity to the other sentences; empty for a single sentence."""
    out = []
    for d in docs:
        words = _lists(d)
        n = len(words)
        if n < 2:
            out.append(np.zeros(0))
            continue
        m = Cosine(words)
        out.append(1 - (m.times(np.ones(n)) - m.own) / (n - 1))
    return pd.Series(out)


def selected(sents: Column, info: Column, n: int | Column) -> Column:
    """The n best sentences in document order."""
    n = F.lit(n) if isinstance(n, int) else n
    ranked = F.zip_with(sents, info["ranks"], lambda s, r: F.struct(s.alias("s"), r.alias("r")))
    return F.transform(F.filter(ranked, lambda x: x["r"] <= n), lambda x: x["s"])


def summary_sentences(text, algorithm: str = "lexrank", n: int = 5) -> Column:
    """array<string>; n = 0 stands for 5, a negative n selects none."""
    s = sentences(text)
    return selected(s, ranking(sentence_words(s), algorithm), n or 5)


def summarize(text, algorithm: str = "lexrank", n: int = 5) -> Column:
    """struct<summary, tokens_in, tokens_out, reduction>."""
    t = F.col(text) if isinstance(text, str) else text
    summary = F.concat_ws(" ", summary_sentences(t, algorithm, n))
    before, after = F.floor(n_bytes(t) / 4).cast("int"), F.floor(n_bytes(summary) / 4).cast("int")
    return F.struct(summary.alias("summary"), before.alias("tokens_in"), after.alias("tokens_out"), reduction(before, after).alias("reduction"))


def explained(text, algorithm: str = "lexrank", n: int = 5) -> tuple[Column, str | None]:
    """(explain's struct, no note), or for an algorithm that doesn't explain itself the summary alone and a note that says so."""
    if algorithm in ("lexrank", "textrank"):
        return explain(text, algorithm, n), None
    return summary_sentences(text, algorithm, n), f'note: explain not supported for algorithm "{algorithm}"; running without diagnostics'


def explain(text, algorithm: str = "lexrank", n: int = 5) -> Column:
    """Everything a report says: counts, statistics, and each sentence with score, rank and whether it was selected."""
    if algorithm not in ("lexrank", "textrank"):
        raise ValueError("only lexrank and textrank explain themselves")
    s = sentences(text)
    info = ranking(sentence_words(s), algorithm, True)
    scored = F.zip_with(info["scores"], info["ranks"], lambda x, r: F.struct(x.alias("score"), r.alias("rank")))
    joined = F.zip_with(s, scored, lambda t, x: F.struct(t.alias("sentence"), x.alias("x")))
    row = lambda j, i: F.struct(i.alias("index"), j["x"]["score"].alias("score"), j["x"]["rank"].alias("rank"), (j["x"]["rank"] <= n).alias("selected"), j["sentence"].alias("sentence"))
    kept = ("iterations", "converged", "vocab_size", "idf_min", "idf_max", "sim_pairs", "sim_nonzero", "sim_max", "sim_mean")
    return F.struct(F.lit(algorithm).alias("algorithm"), F.size(s).alias("input_sentences"), F.least(F.size(s), F.lit(max(0, n))).alias("selected"), *(info[k].alias(k) for k in kept), F.transform(joined, row).alias("scores"))
