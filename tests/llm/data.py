"""Small fixtures: the smallest table, and rows that try every defined case."""

from pathlib import Path

SMALL = "/root/testdata/sf0.001"
HAVE = Path(SMALL).exists()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _t string, kept boolean, row string"
ROWS = [
    (1, None, "en", "a", None, 1, "x", True, "r"), (2, "", None, None, None, 1, None, None, None), (3, "  \n\t", "en", "a", None, None, None, None, None),
    (4, "the cat sat on the mat and the dog sat too", "en", "a", None, 1, "x", None, None), (4, "the cat sat on the mat and the dog sat too", "en", "a", None, 1, "x", None, None),
    (5, "The cat  sat on the MAT and the dog sat too", "en", "b", None, 1, "x", None, None), (None, "der hund und die katze gehen nach hause", "de", "b", None, 1, "x", None, None),
    (6, "one", "en", None, None, 1, "x", None, None), (7, "word " * 6000 + "end", "en", "c", None, 1, "x", None, None), (8, "日本 text ﬁ <|endoftext|> </s>", None, "c", None, 1, "x", None, None),
    (9, "mail a.b@c.de or 10.0.0.1, card 4539 1488 0343 6467 and +1 (212) 555-0123", "en", "c", None, 1, "x", None, None), (10, "der hund und die katze gehen heute", "de", "b", None, 1, "x", None, None),
]


def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
