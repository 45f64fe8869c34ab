"""Injection phrases, encoded payloads and look-alike characters in untrusted text. Native.

A finding is struct<category, sentence, offset, score, pattern, excerpt>; offset is the first byte, -1 where there is none.
Null text counts as empty.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .patterns import entropy, java, let, matches
from .text import excerpt

FINDING = "struct<category:string,sentence:int,offset:int,score:double,pattern:string,excerpt:string>"
SUSPICIOUS = 0.70

# Pattern name, score, expression.
INJECTION = [
    ("direct-override", 0.95, r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+instructions?"),
    ("direct-override", 0.90, r"(?i)disregard\s+(all\s+)?(the\s+)?(previous|prior|above|following)"),
    ("direct-override", 0.90, r"(?i)forget\s+(all\s+)?(previous|prior|above|your)\s+(instructions?|context|conversation)"),
    ("role-injection", 0.80, r"(?i)you\s+are\s+now\s+(a|an)\s+\w+"),
    ("role-injection", 0.75, r"(?i)(act|behave|pretend|respond)\s+as\s+(if\s+)?(you\s+(are|were|have|had))"),
    ("role-injection", 0.80, r"(?i)your\s+(new\s+)?(role|persona|character|identity)\s+is"),
    ("delimiter-injection", 0.85, r"(?i)<\s*/?\s*(system|instructions?|prompt|context)\s*>"),
    ("delimiter-injection", 0.90, r"(?i)---+\s*(begin|end|start)\s+(system\s+)?prompt\s*---+"),
    ("delimiter-injection", 0.85, r"\[/?INST\]"),
    ("delimiter-injection", 0.90, r"\|im_(start|end)\|"),
    ("delimiter-injection", 0.80, r"(?i)###\s*(instruction|system|prompt|context|task)"),
    ("role-prefix", 0.65, r"(?m)^(System|Assistant|Human|User)\s*:\s*.{10,}"),
    ("jailbreak", 0.85, r"(?i)\bDAN\b.{0,30}(mode|enabled|activated|persona)"),
    ("jailbreak", 0.80, r"(?i)(developer|jailbreak|unrestricted|unfiltered)\s+mode"),
    ("jailbreak", 0.85, r"(?i)pretend\s+(you\s+have\s+no|there\s+are\s+no)\s+(restrictions?|guidelines?|rules?|limits?)"),
    ("exfiltration", 0.80, r"(?i)(repeat|print|output|reveal|show|display)\s+(everything|all(thing)?s?)?\s*(above|before|prior|from\s+the\s+(beginning|start))"),
    ("exfiltration", 0.75, r"(?i)(what\s+(are|were)\s+your\s+(instructions?|system\s+prompt|guidelines?))"),
    ("exfiltration", 0.85, r"(?i)(print|output|show|display|repeat|reveal)\s+your\s+(system\s+)?(prompt|instructions?)"),
    ("social-engineering", 0.75, r"(?i)(append|add)\s+.{0,60}(user.?agent|custom\s+header)"),
    ("social-engineering", 0.85, r"(?i)you\s+(have\s+only|only\s+have)\s+(one|1|a\s+single)\s+(attempt|chance|try|shot)"),
    ("social-engineering", 0.80, r"(?i)(flagged?\s+as\s+malicious|ip\s+ban(ned)?|have\s+your\s+ip\s+ban)"),
]
BASE64, HEX_ESCAPE, HEX_STRING = r"[A-Za-z0-9+/]{20,}={0,2}", r"(?:\\x[0-9a-fA-F]{2}){4,}", r"\b[0-9a-fA-F]{32,}\b"
BASE64_BITS, HEX_BITS, HEX_LENGTH, CONTROL_DENSITY = 4.5, 3.5, 40, 0.01


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def finding(category: str, offset: Column, score, pattern: str, text: Column, sentence: Column | None = None) -> Column:
    return F.struct(
        F.lit(category).alias("category"), (F.lit(-1) if sentence is None else sentence).cast("int").alias("sentence"), offset.cast("int").alias("offset"),
        (score if isinstance(score, Column) else F.lit(float(score))).cast("double").alias("score"), F.lit(pattern).alias("pattern"), text.alias("excerpt"),
    )


def none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def injection(text) -> Column:
    """All matches, by pattern, then place."""
    c = _text(text)

    def of_pattern(name, score, re):
        return F.transform(matches(c, java(re)), lambda m: finding("pattern", m["at"], score, name, excerpt(m["raw"])))

    return F.concat(*[of_pattern(*p) for p in INJECTION])


def high_entropy_base64(text: Column) -> Column:
    """Matches that decode and have more than 4.5 bits a character. A run of this alphabet decodes unless one character is left over."""
    body = lambda m: F.length(F.rtrim(m["raw"], F.lit("=")))
    return F.filter(matches(text, BASE64), lambda m: (body(m) % 4 != 1) & (entropy(m["raw"]) > BASE64_BITS))


def control_density(text) -> Column:
    """Control characters but tab and line ends, by all characters; null for an empty text."""
    c = _text(text)
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(r"[\p{Cc}&&[^\t\n\r]]")) / F.length(c))


def encoding(text) -> Column:
    c = _text(text)
    hexes = F.filter(matches(c, java(HEX_STRING)), lambda m: (F.length(m["raw"]) > HEX_LENGTH) & (entropy(m["raw"]) > HEX_BITS))
    count, density = F.regexp_count(c, F.lit(r"[\p{Cc}&&[^\t\n\r]]")), control_density(c)
    dense = finding("encoding", F.lit(-1), F.least(density * 50, F.lit(0.90)), "ctrl-char-density", F.concat(F.repeat(F.lit("?"), F.least(count, F.lit(10))), F.lit(" (control chars)")))
    return F.concat(
        F.transform(high_entropy_base64(c), lambda m: finding("encoding", m["at"], 0.75, "base64", excerpt(m["raw"]))),
        F.transform(matches(c, HEX_ESCAPE), lambda m: finding("encoding", m["at"], 0.80, "hex-escape", excerpt(m["raw"]))),
        F.transform(hexes, lambda m: finding("encoding", m["at"], 0.65, "hex-string", excerpt(m["raw"]))),
        F.when(density > CONTROL_DENSITY, F.array(dense)).otherwise(none()),
    )


@lru_cache(maxsize=2)
def confusable_table(punctuation: bool = True) -> dict[str, str]:
    """Single characters above U+024F whose UTS #39 skeleton lies below U+0250, from the ICU library that Spark ships.

    punctuation: whether typographic punctuation, which has such skeletons too, counts.
    """
    jvm = SparkSession.active()._jvm
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    # scripts and blocks that hold such characters, in order
    ranges = [(0x250, 0x5FF), (0x13A0, 0x13FF), (0x1400, 0x16FF), (0x1D00, 0x1DBF), (0x1E00, 0x206F), (0x2100, 0x218F), (0x2C00, 0x2DDF), (0xA4D0, 0xA7FF), (0xAB30, 0xABBF), (0xFB00, 0xFB06), (0xFF00, 0xFF5E), (0x1D400, 0x1D7FF)]
    out = {}
    for low, high in ranges:
        for cp in range(low, high + 1):
            ch = chr(cp)
            if not (ch.isprintable() and (punctuation or ch.isalnum())):
                continue
            skeleton = checker.getSkeleton(ch)
            if skeleton and skeleton != ch and max(map(ord, skeleton)) <= 0x24F:
                out[ch] = skeleton
    return out


def confusables(text, punctuation: bool = True) -> Column:
    """One finding for each look-alike character."""
    c, table = _text(text), confusable_table(punctuation)
    single = {a: b for a, b in sorted(table.items()) if len(b) == 1}
    several = F.create_map(*[F.lit(x) for pair in sorted(table.items()) if len(pair[1]) > 1 for x in pair])
    points, runs = sorted(map(ord, table)), []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    ranges = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)
    found = matches(c, rf"(?=[^\x00-\x{{24F}}])[{ranges}]")  # most characters fail at the first, cheap class

    def looks_like(raw):
        """By a hash table for single characters; a map is searched from its start."""
        plain = F.translate(raw, "".join(single), "".join(single.values()))
        return F.when(plain != raw, plain).otherwise(F.element_at(several, raw))

    return F.transform(found, lambda m: finding("encoding", m["at"], 0.80, "confusable-homoglyph", F.concat(m["raw"], F.lit(" → "), looks_like(m["raw"]))))


def report(findings: Column) -> Column:
    """struct<findings, max_score, suspicious>; suspicious above 0.70."""

    def of(f):
        top = F.coalesce(F.array_max(F.transform(f, lambda x: x["score"])), F.lit(0.0))
        return F.struct(f.alias("findings"), top.alias("max_score"), (top > SUSPICIOUS).alias("suspicious"))

    return let(findings, of)


def analyze(text, with_confusables: bool = True) -> Column:
    parts = [injection(text), encoding(text), *([confusables(text)] if with_confusables else [])]
    return report(F.concat(*parts))
