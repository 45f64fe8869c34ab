"""Token counts without token ids: pieces are counted once for each distinct pre-token.

The piece model (byte-pair merges, identity normaliser, a dummy space in front) never merges across the start of a run of spaces
or across a line feed: no piece has a space after anything else, or a line feed at all (`check_model` makes sure). So a text
falls into pre-tokens, each is encoded on its own, and a text's count is the sum over its pre-tokens.

1. Pre-tokens are counted in each task and summed by a shuffle: one row for each distinct pre-token.
2. Each of these is encoded once, where the shuffle left it, and only the number of its pieces is kept.
3. Second pass: pre-tokens by document, looked up (see lexicon: common ones from a broadcast of bounded size, all others by a
   join), and summed. No ids are kept anywhere.

Defined cases: a null text is empty and has no tokens; equal rows are rows of their own; special strings in a text are plain text,
as the library has it by default; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon
from .common import durable

SPACE = "▁"  # how the model writes a space
RUN = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
#: So many distinct pre-tokens a task holds before it gives their counts out.
HELD = 300_000
_models: dict = {}


def pre_tokens(text: str) -> list[str]:
    """Keys whose pieces add up to the text's: "a" is a space and a, "\\na" a line feed and a; further spaces are written SPACE."""
    if not text:
        return []
    if "  " not in text and SPACE not in text and text[0] != " ":
        return text.replace("\n", " \n").split(" ")
    return [m[1:] if m[0] == SPACE else m for m in RUN.findall(SPACE + text.replace(" ", SPACE))]


def model(path: str):
    import sentencepiece

    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def check_model(path: str) -> None:
    """ValueError if pre-tokens of this model can't be encoded on their own."""
    m = model(path)
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE) or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token boundary")
    if m.encode("ﬁ", out_type=str)[-1:] != m.encode("xﬁ", out_type=str)[-1:] or m.encode("  a", out_type=str)[0][:1] != SPACE:
        raise ValueError("the model normalises its text")


def pieces(m, keys: list[str]) -> list[int]:
    """The number of pieces of each key; the dummy space is part of a key unless it starts with a line feed."""
    return [len(ids) - (k[:1] == "\n") if k else 1 for k, ids in zip(keys, m.encode(keys, num_threads=1), strict=True)]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", common_limit: int = lexicon.LIMIT) -> DataFrame:
    """One row per input row: <id_col>, n_bytes, n_tokens, over_limit."""
    check_model(model_path)
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = pa.schema([("piece", pa.string()), ("freq", pa.int64())])

    def count(batches):
        def add(counts, batch):
            for t in batch.column(0).to_pylist():
                counts.update(pre_tokens(t))

        yield from lexicon.flushed(Counter(), batches, add, HELD, kind)

    def encode(batches):
        m = model(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces(m, b.column(0).to_pylist()), pa.int32())], names=["piece", "freq", "n"])

    distinct = texts.mapInArrow(count, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    table = durable(distinct.mapInArrow(encode, "piece string, freq long, n int"), "token-pieces")
    shared = spark.sparkContext.broadcast({r["piece"]: r["n"] for r in lexicon.common(table, "freq", common_limit).select("piece", "n").toLocalIterator()})

    def look_up(batches):
        known = shared.value
        for b in batches:
            ids, total, rare = b.column(0), [], []
            for t in b.column(1).to_pylist():
                n, odd = 0, {}
                for p in pre_tokens(t or ""):
                    k = known.get(p)
                    if k is None:
                        odd[p] = odd.get(p, 0) + 1
                    else:
                        n += k
                total.append(n)
                rare.append([{"piece": p, "freq": f} for p, f in odd.items()])
            yield pa.RecordBatch.from_arrays([ids, b.column(2), pa.array(total, pa.int64()), pa.array(rare, pa.list_(pa.struct([("piece", pa.string()), ("freq", pa.int64())])))], names=["id", "n_bytes", "known", "rare"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("n_bytes long, known long, rare array<struct<piece:string,freq:long>>").fields])
    found = durable(rows.mapInArrow(look_up, schema).withColumn("row", F.monotonically_increasing_id()), "token-rows")
    rest = found.select("row", F.explode("rare").alias("r")).select("row", "r.piece", "r.freq").join(table.select("piece", "n"), "piece")
    rest = rest.groupBy("row").agg(F.sum(F.col("freq") * F.col("n")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return found.join(rest, "row", "left").select(F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
