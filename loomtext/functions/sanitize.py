"""Invisible characters and compatibility forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import vectorised
from .detect import _text
from .patterns import matches

# What is removed, beside every other format character (category Cf).
INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{E000}-\x{F8FF}\x{E0000}-\x{E01FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}\p{Cf}]"
# Names in reports.
NAMES = {
    0x00AD: "SOFT HYPHEN", 0x200B: "ZERO WIDTH SPACE", 0x200C: "ZERO WIDTH NON-JOINER", 0x200D: "ZERO WIDTH JOINER", 0x200E: "LEFT-TO-RIGHT MARK", 0x200F: "RIGHT-TO-LEFT MARK",
    0x2028: "LINE SEPARATOR", 0x2029: "PARAGRAPH SEPARATOR", 0x202A: "LEFT-TO-RIGHT EMBEDDING", 0x202B: "RIGHT-TO-LEFT EMBEDDING", 0x202C: "POP DIRECTIONAL FORMATTING",
    0x202D: "LEFT-TO-RIGHT OVERRIDE", 0x202E: "RIGHT-TO-LEFT OVERRIDE", 0x2060: "WORD JOINER", 0x2061: "FUNCTION APPLICATION", 0x2062: "INVISIBLE TIMES", 0x2063: "INVISIBLE SEPARATOR",
    0x2064: "INVISIBLE PLUS", 0x2066: "LEFT-TO-RIGHT ISOLATE", 0x2067: "RIGHT-TO-LEFT ISOLATE", 0x2068: "FIRST STRONG ISOLATE", 0x2069: "POP DIRECTIONAL ISOLATE", 0xFEFF: "ZERO WIDTH NO-BREAK SPACE (BOM)",
}
# Category by first range that holds the character; other format characters are `format`, the rest `control`.
CATEGORIES = [
    (0x202A, 0x202E, "bidi-control"), (0x2066, 0x2069, "bidi-isolate"), (0x200B, 0x200F, "zero-width"), (0x00AD, 0x00AD, "soft-hyphen"), (0xFEFF, 0xFEFF, "bom"),
    (0xE000, 0xF8FF, "private-use"), (0xE0000, 0xE01FF, "tags-block"),
]


def strip_invisible(text) -> Column:
    return F.regexp_replace(_text(text), INVISIBLE, "")


@vectorised("string")
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text) -> Column:
    """NFKC. Spark has no built-in for it, so this is the one step that needs Python; ASCII comes back as it was."""
    return _nfkc(_text(text))


def sanitize(text) -> Column:
    return nfkc(strip_invisible(text))


def code_point(ch: Column) -> Column:
    """Of a one-character string."""
    return F.ascii(ch)


def report_invisibles(text) -> Column:
    """array<struct<codepoint, name, offset, category>> of what strip_invisible removes."""

    def one(m):
        cp = code_point(m["raw"])
        name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), cp), F.format_string("U+%04X", cp))
        kind = F.when(F.lit(False), "")
        for low, high, what in CATEGORIES:
            kind = kind.when(cp.between(low, high), what)
        kind = kind.when(m["raw"].rlike(r"\p{Cf}"), "format").otherwise("control")
        return F.struct(cp.alias("codepoint"), name.alias("name"), m["at"].alias("offset"), kind.alias("category"))

    return F.transform(matches(_text(text), INVISIBLE), one)
