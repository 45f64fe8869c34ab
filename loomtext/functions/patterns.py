"""Regular expressions in Java's dialect with RE2's meaning, and matches with their places."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "(?-i:[0-9A-Za-z_])"
_EDGE = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


#: One character that is a word character whatever it is; an atom of such characters, not to be left out.
_ONE = r"(?:\\[dw]|[0-9A-Za-z_]|\[(?:[0-9A-Za-z](?:-[0-9A-Za-z])?|_)+\])"
_KEPT = r"(?![*?]|\{0)"
_CASES = rf"\(\?:{_ONE}{_KEPT}[^()|]*(?:\|{_ONE}{_KEPT}[^()|]*)*\){_KEPT}"  # a group whose every case starts with one
_OPENS, _CLOSES = re.compile(rf"{_ONE}{_KEPT}|{_CASES}"), re.compile(rf"{_ONE}(?:\+|\{{[1-9][0-9]*,?[0-9]*\}})?\Z")


def _edge(pattern: str, at: int) -> str:
    """The edge \\b at a place: half of it where a word character is sure to stand beside it. Folding takes k and s beyond ASCII, so they aren't sure with (?i)."""
    sure = lambda m: m and not ("(?i)" in pattern and re.search(r"[ksKS-]", m[0]))
    if sure(_OPENS.match(pattern, at + 2)):
        return rf"(?<!{_WORD})"
    return rf"(?!{_WORD})" if sure(_CLOSES.search(pattern[:at])) else _EDGE


def java(pattern: str) -> str:
    """Ask Java for ASCII white space and word edges, Unicode case folding, and line feeds as the only line ends."""
    out, k, in_class = "", 0, False
    while k < len(pattern):
        pair = pattern[k : k + 2]
        if pair == r"\s":
            out += r"\t\n\f\r " if in_class else r"[\t\n\f\r ]"
        elif pair == r"\b" and not in_class:
            out += _edge(pattern, k)
        elif pair[0] == "\\":
            out += pair
        else:
            in_class = (in_class or pair[0] == "[") and pair[0] != "]"
            out, k = out + pair[0], k + 1
            continue
        k += 2
    return "(?d)" + out.replace("(?i)", "(?iu)")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside a higher-order function an expression is otherwise computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upto(sizes: Column) -> Column:
    """Running sums of an array<struct<at, start>>, in blocks of the square root of its size: a sum takes the blocks before it and its own block's head."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"))
    add = lambda s, y: F.struct((s["at"] + y["at"]).alias("at"), (s["start"] + y["start"]).alias("start"))
    total = lambda a, first, n: F.aggregate(F.slice(a, first, n), zero, add)

    def of(z):
        n, width = F.size(z["sizes"]), z["width"]
        firsts = F.sequence(F.lit(1), n, width)

        def placed(y):
            at = lambda i: add(F.get(y["heads"], F.floor(i / width).cast("int")), total(z["sizes"], i - i % width + 1, i % width + 1))
            return F.transform(z["sizes"], lambda x, i: at(i))

        blocks = F.transform(firsts, lambda k: total(z["sizes"], k, width))
        return let(blocks, lambda b: let(F.struct(F.transform(b, lambda x, k: total(b, F.lit(1), k)).alias("heads")), placed))

    return let(F.struct(sizes.alias("sizes"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes))).cast("int")).alias("width")), of)


def holds(text: Column, pattern: str, needs: str = "") -> Column:
    """Whether there is a match. needs: a string that every match has; a text without it isn't searched."""
    return F.contains(text, F.lit(needs)) & text.rlike(pattern) if needs else text.rlike(pattern)


def matches(text: Column, pattern: str, needs: str = "") -> Column:
    """array<struct<at: first byte, start: first character, raw>> of the leftmost non-overlapping matches.

    Matches and the gaps between them are two arrays; a match starts after all gaps up to it and all matches before it.
    """
    regex = F.lit(pattern)

    def placed(z):
        def step(i):
            size = lambda f: f(F.get(z["gaps"], i)) + F.when(i > 0, f(F.get(z["found"], i - 1))).otherwise(0)
            return F.struct(size(F.octet_length).alias("at"), size(F.length).alias("start"))

        steps = F.transform(z["found"], lambda x, i: step(i))
        return F.zip_with(z["found"], _upto(steps), lambda x, s: F.struct(s["at"].alias("at"), s["start"].alias("start"), x.alias("raw")))

    both = F.struct(F.regexp_extract_all(text, regex, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(holds(text, pattern, needs), let(both, placed)).otherwise(F.array().cast("array<struct<at:int,start:int,raw:string>>"))


def entropy(token: Column) -> Column:
    """Bits per character."""

    def of(chars):
        share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / F.size(chars).cast("double")
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))

    return let(F.filter(F.split(token, ""), lambda c: c != ""), of)
