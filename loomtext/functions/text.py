"""Sentences, words, sizes: column functions of native expressions, so they run inside whole-stage codegen or as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the tokenizer counts it, and as RE2's \s does.
SPACE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
RE_SPACE = r"[\t\n\f\r ]"
#: Between punctuation and a quote or white space that an upper-case letter or a quote follows.
SENTENCE_END = rf"(?<=[.!?])(?=['\"’]?{RE_SPACE}+[A-Z'\"“])"
SENTENCE_CAP = 2000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(text) -> Column:
    """Without white space (any of Unicode) at either end."""
    return F.regexp_replace(_col(text), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def sentences(text) -> Column:
    """array<string>, trimmed, in order, none empty; null counts as empty."""
    parts = F.split(F.coalesce(_col(text), F.lit("")), SENTENCE_END, -1)
    return F.filter(F.transform(parts, trim), lambda s: s != "")


#: The same white space, quickly told from most of a text: a class is tried from its left.
_BLANK = rf"[[\x00- \x7F-\x{{10FFFF}}]&&[{SPACE}]]"
_OTHER = rf"[^a-z \p{{L}}\p{{Nd}}{SPACE}-]"


def words(sentence) -> Column:
    """array<string>: lower case, letters, digits and inner hyphens only, none empty."""
    kept = F.regexp_replace(F.lower(F.coalesce(_col(sentence), F.lit(""))), _OTHER, "")

    def inner(k):
        plain = F.regexp_replace(F.regexp_replace(k, "-+", "-"), rf"(?<![^{SPACE}])-|-(?![^{SPACE}])", "")
        return F.filter(F.split(F.when(F.contains(k, F.lit("-")), plain).otherwise(k), f"{_BLANK}+", -1), lambda w: w != "")

    return F.get(F.transform(F.array(kept), inner), F.lit(0))


def sentence_words(sents) -> Column:
    """array<array<string>> of an array of sentences."""
    return F.transform(_col(sents), words)


def capped(text, cap: int = SENTENCE_CAP) -> Column:
    """The text, or its first cap sentences joined by a space if it has more."""
    s = sentences(text)
    return F.when(F.size(s) > cap, F.concat_ws(" ", F.slice(s, 1, cap))).otherwise(_col(text))


def n_bytes(text) -> Column:
    return F.coalesce(F.octet_length(_col(text)), F.lit(0))


def tokens(text) -> Column:
    """A quarter of the bytes."""
    return F.floor(n_bytes(text) / 4).cast("int")


def excerpt(text, runes: int = 80, mark: str = "…") -> Column:
    c = _col(text)
    return F.when(F.length(c) > runes, F.concat(F.substring(c, 1, runes), F.lit(mark))).otherwise(c)


def preview(text, runes: int = 55) -> Column:
    return excerpt(trim(text), runes)


def reduction(tokens_in, tokens_out) -> Column:
    """Percent saved, by integer division; 0 for an empty input."""
    return F.when(_col(tokens_in) > 0, 100 - F.floor(_col(tokens_out) * 100 / _col(tokens_in))).otherwise(0).cast("int")


def thousands(n) -> Column:
    return F.format_number(_col(n), 0)
