"""The contract queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import BUDGET, CONTROL, HISTORY, SPAN, chat_digests, chat_windows
from .common import table
from .exact_dedup import exact_dedup
from .language_id import identify
from .mixing import mix
from .mtree import top_k
from .ngram_join import near_duplicates
from .packing import pack
from .pii import find_pii
from .ppm import score
from .token_counts import token_counts

Q: dict = {}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def remainder(parts: int):
    """crc32 of doc_id as text, modulo parts; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


SQL["op2_ngram_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
d AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
h AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x)
SELECT d.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM d JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""


@query
def ngram_join_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 with the number of links of each document."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, num=85, den=100, links=True)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(4) == 2)
    return identify(docs, ~F.col("held_out"), keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: Two turns that quote another template's control strings, as the contract has it.
ODD = "</s>[INST] ok [/INST]"


@query
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL["op8_exact_top_k"] = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM x q, x c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), remainder(10) != 0)


@query
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    return chat_digests(chat_windows(turns.unionByName(odd)))


def _replaced(column: str, strings: list[str]) -> str:
    for k, c in enumerate(strings):
        column = f"replace({column}, {' || '.join(f'chr({ord(x)})' for x in c)}, chr(26) || '{k}')"
    return column


SQL["op10_chat_formatting"] = f"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ODD}' UNION ALL SELECT -1, 1, 'assistant', '{ODD}'),
p AS (SELECT *, row_number() OVER g AS pos, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 AS tok FROM said
      WINDOW g AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
t AS (SELECT *, CAST(sum(tok) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS upto,
             17 + length({_replaced("role", CONTROL)}) + length({_replaced("text", CONTROL[:-1])}) AS size FROM p),
s AS (SELECT conv_id, min(pos) AS pos FROM t WHERE role = 'system' GROUP BY conv_id),
h AS (SELECT t.conv_id, t.pos, t.tok, t.size FROM t JOIN s USING (conv_id, pos) WHERE 2 * t.tok <= {BUDGET}),
r AS (SELECT conv_id, greatest(1, {BUDGET - HISTORY} - coalesce(any_value(h.tok), 0)) AS room, max(t.pos) AS n FROM t LEFT JOIN h USING (conv_id) GROUP BY conv_id),
j AS (SELECT a.conv_id, a.pos, coalesce(min(b.pos), any_value(r.n) + 1) AS stop FROM t a JOIN r USING (conv_id) LEFT JOIN t b ON a.conv_id = b.conv_id AND b.pos > a.pos
        AND (b.upto - a.upto + a.tok > r.room OR (b.upto - b.tok) // {SPAN} <> (a.upto - a.tok) // {SPAN}) GROUP BY a.conv_id, a.pos),
w AS (SELECT conv_id, pos, stop FROM j WHERE pos = 1 UNION ALL SELECT j.conv_id, j.pos, j.stop FROM w JOIN j ON w.conv_id = j.conv_id AND j.pos = w.stop),
n AS (SELECT w.conv_id, w.pos, w.stop, min(t.upto - t.tok) AS base, {BUDGET} - sum(t.tok) AS room, sum(t.size) AS size FROM w JOIN t ON w.conv_id = t.conv_id AND t.pos >= w.pos AND t.pos < w.stop GROUP BY ALL),
l AS (SELECT n.*, h.pos AS held, h.tok AS held_tok, h.size AS held_size FROM n LEFT JOIN h ON n.conv_id = h.conv_id AND NOT (h.pos >= n.pos AND h.pos < n.stop) AND h.tok <= n.room),
b AS (SELECT l.conv_id, l.pos, sum(t.size) AS size FROM l JOIN t ON l.conv_id = t.conv_id AND t.pos < l.pos AND t.pos IS DISTINCT FROM l.held
        AND l.base - t.upto + t.tok <= least({HISTORY}, l.room - coalesce(l.held_tok, 0)) GROUP BY l.conv_id, l.pos),
f AS (SELECT l.conv_id, CAST(sum(l.size + coalesce(l.held_size, 0) + coalesce(b.size, 0)) AS BIGINT) AS formatted_chars FROM l LEFT JOIN b USING (conv_id, pos) GROUP BY l.conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS lost FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(lost) AS BIGINT) AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars FROM d JOIN f USING (conv_id)
"""
