"""Personal data and secrets: findings by line, and redaction. Native."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import FINDING, _text, finding, high_entropy_base64
from .patterns import holds, java, let, matches
from .text import excerpt

# Name and expression, in order of report; the block of a private key is the one that spans lines.
PATTERNS = [
    ("api-key", r"Bearer\s+[A-Za-z0-9._~+/\-]+=*"), ("api-key", r"\bsk-[A-Za-z0-9_\-]{20,}\b"), ("api-key", r"\bAIza[A-Za-z0-9_\-]{35,}\b"), ("api-key", r"\bAKIA[A-Za-z0-9]{16,}\b"),
    ("github-token", r"\bgh[opsur]_[A-Za-z0-9]{36,}\b"), ("github-token", r"\bgithub_pat_[A-Za-z0-9_]{50,}\b"), ("slack-token", r"\b(?:xox[abprs]|xapp)-[A-Za-z0-9-]{10,}\b"),
    ("private-key", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----"), ("jwt", r"\b[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b"),
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"), ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"), ("credit-card", r"\b(?:\d[ \-]?){12,15}\d\b"),
]
#: For each of them, a string that every match has.
NEEDS = ("Bearer", "sk-", "AIza", "AKIA", "gh", "github_pat_", "x", "PRIVATE KEY-----", ".", "@", "-", "")
MULTILINE, CHECKED = "private-key", "credit-card"
SCORE = 0.95


def luhn_valid(text) -> Column:
    """13 to 16 digits that pass the check sum; other characters are ignored."""
    digits = F.regexp_replace(_text(text), "[^0-9]", "")
    return F.coalesce(F.length(digits).between(13, 16) & F.call_function("luhn_check", digits), F.lit(False))


def _found(text: Column, name: str, re: str, needs: str) -> Column:
    """A match that fails its check is dropped, having taken its text."""
    m = matches(text, java(re), needs)
    return F.filter(m, lambda x: luhn_valid(x["raw"])) if name == CHECKED else m


def _place(text: Column, start: Column) -> tuple[Column, Column]:
    """Line (from 1) and byte in the line of a character position."""
    before = F.substr(text, F.lit(1), start)
    return F.size(F.split(before, "\n", -1)), F.octet_length(F.substring_index(before, "\n", -1))


def findings(text) -> Column:
    """array of findings: by line, then pattern, then place; blocks over several lines last. `sentence` is the line."""
    c = _text(text)

    def of_line(line, k):
        def of_pattern(name, re, needs):
            return F.transform(_found(line, name, re, needs), lambda m: finding("pii", m["at"], SCORE, name, excerpt(m["raw"], 12, "..."), k + 1))

        return F.concat(*[of_pattern(n, re, needs) for (n, re), needs in zip(PATTERNS, NEEDS, strict=True) if n != MULTILINE])

    # a line's match is one of the text, so most texts are searched once and not line by line
    some = reduce(or_, [holds(c, java(re), needs) for (n, re), needs in zip(PATTERNS, NEEDS, strict=True) if n != MULTILINE])
    lines = F.when(some, F.transform(F.split(c, "\n", -1), of_line)).otherwise(F.array().cast(f"array<array<{FINDING}>>"))

    def block(m):
        line, at = _place(c, m["start"])
        return finding("pii", at, SCORE, MULTILINE, excerpt(m["raw"], 12, "..."), line)

    return F.concat(F.flatten(lines), *(F.transform(matches(c, java(re), needs), block) for (n, re), needs in zip(PATTERNS, NEEDS, strict=True) if n == MULTILINE))


def redact(text) -> Column:
    """struct<text, findings>: every span replaced by [REDACTED:name]; earliest start wins, then the longest, then the order of patterns.

    High-entropy base64 counts as `secret`.
    """
    c = _text(text)
    named = [*((n, _found(c, n, re, needs)) for (n, re), needs in zip(PATTERNS, NEEDS, strict=True)), ("secret", high_entropy_base64(c))]

    def spans_of(k, name, found):
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["start"] - F.length(x["raw"])).alias("back"), F.lit(k).alias("k"), F.lit(name).alias("name"), x["raw"].alias("raw")))

    spans = F.concat(*[spans_of(k, n, m) for k, (n, m) in enumerate(named)])
    kept_type = "array<struct<start:int,end:int,name:string,raw:string>>"
    kept = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("end"), F.array().cast(kept_type).alias("out")),
        lambda s, x: F.when(x["start"] < s["end"], s).otherwise(F.struct((-x["back"]).alias("end"), F.concat(s["out"], F.array(F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["name"].alias("name"), x["raw"].alias("raw")))).alias("out"))),
        lambda s: s["out"],
    )


    def report(x):
        line, at = _place(c, x["start"])
        return F.struct(x["name"].alias("pattern"), excerpt(x["raw"], 12, "...").alias("excerpt"), line.alias("line"), at.alias("offset"))

    def done(kept):
        def part(x, i):
            last = F.coalesce(F.get(kept, i - 1)["end"], F.lit(0))
            return F.concat(F.substr(c, last + 1, x["start"] - last), F.lit("[REDACTED:"), x["name"], F.lit("]"))

        tail = F.substr(c, F.coalesce(F.element_at(kept, -1)["end"], F.lit(0)) + 1, F.length(c))
        return F.struct(F.when(F.size(kept) > 0, F.concat(F.concat_ws("", F.transform(kept, part)), tail)).otherwise(c).alias("text"), F.transform(kept, report).alias("findings"))

    return let(kept, done)
