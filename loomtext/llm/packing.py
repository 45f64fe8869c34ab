"""Best-fit packing into fixed-length sequences by a grouping genetic algorithm.

Documents become pieces of at most `capacity` tokens; full pieces are sequences of their own. The others are dealt over islands
of about ISLAND pieces. On an island an individual is a grouping of its pieces into bins, the first of them best-fit decreasing. An
island whose grouping has as few bins as its tokens need is closed: no grouping can be better. On any other, crossover injects
well-filled bins of one parent whole into the other, removes the bins there that hold an injected piece, and puts the displaced
pieces back best-fit decreasing. Fitness is the number of bins, then the mean square fill. Between epochs every island's elite, its
ELITE best-filled bins as multisets of lengths, travels to the next island, which rebuilds them from its own pieces where it can and
takes them into its population. There are EPOCHS epochs, fewer if all islands are closed before. At the end, the pieces of bins with
more than SLACK unused tokens are dealt anew over fewer islands and packed once more, so no island leaves its remainder behind.

Token ids are those of the given tokenizer file. If it is a byte-level BPE whose merges stand in the order of their ids, its vocabulary
and merges are run by tiktoken's merge loop, which gives the same ids in about half the time (`Encoder`); texts with code points
from U+0250 on or with a special token's string, and all texts of any other tokenizer, go through the library itself.

Defined cases: a null text is empty and its piece is the id 0 alone; equal rows are packed as rows of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import math
import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

CAPACITY = 2048
ISLAND, POPULATION, GENERATIONS, EPOCHS, ELITE, SLACK = 4096, 6, 200, 3, 64, 16
#: Token id that ends every document.
LAST = 0

# Fixed value: the pre-token pattern of byte-level tokenizers, and the same for texts without a run of two white spaces, where it needs no look-ahead.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
RUNS = ("  ", "\n\n", " \n", "\n ")
NOT_LATIN, OTHER_BLANK = re.compile("[^\x00-\u024f]"), re.compile("[\t\x0b-\r\x85\xa0]")
_tokenizers: dict = {}


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes and ids if it can be merged in the order of its ids, else None. Byte-level vocabularies write each byte as a printable character."""
    vocabulary, merges = model.get("vocab"), model.get("merges")
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
    if any(a >= b for a, b in zip(made, made[1:])) or len(vocabulary) != 256 + len(made) or not all(c in byte_of for t in vocabulary for c in t):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}


class Encoder:
    """Token ids of texts by a tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before, ranks = parts.get("pre_tokenizer") or {}, None
        if parts.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True):
            ranks = byte_ranks(parts["model"])
        self.whole, self.plain = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) if ranks else None for n, p in (("whole", PATTERN), ("plain", PLAIN)))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit numbers."""
        if self.whole is None or NOT_LATIN.search(text) or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        runs = any(r in text for r in RUNS) or OTHER_BLANK.search(text)
        return (self.whole if runs else self.plain).encode_to_numpy(text).astype("<u4", copy=False).tobytes()


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces; where it must be cut, the first piece takes the remainder."""
    n = len(ids) // 4
    first = n % capacity or capacity
    ends = range(min(n, first), n + 1, capacity)
    view = memoryview(ids)
    return [(s := 0 if k == 0 else e - capacity, e - s, zlib.crc32(view[4 * s : 4 * e])) for k, e in enumerate(ends)]


def fill(bins: list[int], items, lengths: np.ndarray, owner: np.ndarray, capacity: int) -> None:
    """Best fit: items go, in their order, into the bins (their free room; it grows as needed) that they leave fullest, and owner is set."""
    order = sorted((r, b) for b, r in enumerate(bins) if r > 0)
    for i in items:
        n = int(lengths[i])
        at = bisect.bisect_left(order, (n, -1))
        if at < len(order):
            r, b = order.pop(at)
        else:
            r, b = capacity, len(bins)
            bins.append(capacity)
        owner[i], bins[b] = b, r - n
        if r > n:
            bisect.insort(order, (r - n, b))


def decreasing(items: np.ndarray, sizes: np.ndarray) -> list[int]:
    return items[np.argsort(-sizes[items], kind="stable")].tolist()


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    owner = np.full(len(lengths), -1)
    fill([], decreasing(np.arange(len(lengths)), lengths), lengths, owner, capacity)
    return owner


def fitness(owner: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Larger is better: fewer bins, then fuller ones."""
    used = np.bincount(owner, weights=lengths)
    return -len(used), float(((used / capacity) ** 2).mean())


def inject(owner: np.ndarray, groups: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """groups: item -> number of an injected bin, or -1. The injected bins enter whole, bins of owner that share an item with them go, their other items are put back best-fit."""
    enters = groups >= 0
    hit = np.zeros(owner.max() + 1, bool)
    hit[owner[enters]] = True
    displaced = hit[owner] & ~enters
    stays = ~hit[owner]
    child = np.full(len(owner), -1)
    _, child[stays] = np.unique(owner[stays], return_inverse=True)
    base = child.max() + 1 if stays.any() else 0
    _, number = np.unique(groups[enters], return_inverse=True)
    child[enters] = number + base
    placed = child >= 0
    free = capacity - np.bincount(child[placed], weights=lengths[placed]) if placed.any() else np.zeros(0)
    fill([int(x) for x in free], decreasing(np.flatnonzero(displaced), lengths), lengths, child, capacity)
    return child


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Some of b's best-filled bins go into a."""
    used = np.bincount(b, weights=lengths)
    full = np.flatnonzero(used >= np.quantile(used, 0.5))
    chosen = np.zeros(len(used), bool)
    chosen[full[rng.random(len(full)) < rng.uniform(0.1, 0.5)]] = True
    return inject(a, np.where(chosen[b], b, -1), lengths, capacity)


def rebuilt(patterns: list[list[int]], lengths: np.ndarray) -> np.ndarray:
    """Immigrant bins made of own pieces of the same lengths: item -> bin or -1."""
    groups, by = np.full(len(lengths), -1), {}
    for i, n in enumerate(lengths.tolist()):
        by.setdefault(n, []).append(i)
    for k, p in enumerate(patterns):
        took = []
        for n in p:
            if not by.get(n):
                break
            took.append((n, by[n].pop()))
        if len(took) == len(p):
            groups[[i for _, i in took]] = k
        else:
            for n, i in took:
                by[n].append(i)
    return groups


def varied(owner: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """The grouping with some of its bins, chosen by chance, broken up and filled best-fit in an order of noisy lengths."""
    child = owner.copy()
    loose = rng.random(owner.max() + 1) < rng.uniform(0.1, 0.6)
    items, keep = np.flatnonzero(loose[owner]), np.flatnonzero(~loose[owner])
    _, child[keep] = np.unique(owner[keep], return_inverse=True)
    child[items] = -1
    bins = [int(x) for x in capacity - np.bincount(child[keep], weights=lengths[keep])] if len(keep) else []
    fill(bins, decreasing(items, lengths * rng.uniform(0.8, 1.25, len(lengths))), lengths, child, capacity)
    return child


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """No grouping has fewer bins: by the sum of the lengths, or as no two pieces above half a bin share one."""
    return max(math.ceil(lengths.sum() / capacity), int((2 * lengths > capacity).sum()))


def evolve(lengths: np.ndarray, capacity: int, seed: int, start: np.ndarray | None = None, migrants: list[list[int]] = ()) -> tuple[np.ndarray, int]:
    """The best grouping found (item -> bin, from 0), and the number of crossovers that it took: none if the first one can't be bettered."""
    rng, least = np.random.default_rng(seed), least_bins(lengths, capacity)
    people = [best_fit(lengths, capacity) if start is None else np.unique(start, return_inverse=True)[1]]
    if people[0].max() + 1 <= least:
        return people[0], 0
    if migrants and (groups := rebuilt(migrants, lengths)).max() >= 0:
        people.append(inject(people[0], groups, lengths, capacity))
    people += [varied(people[0], lengths, capacity, rng) for _ in range(POPULATION - len(people))]
    rank, made = [fitness(p, lengths, capacity) for p in people], 0
    while made < GENERATIONS and -max(rank)[0] > least:
        a, b = rng.choice(len(people), 2, replace=False)
        if rank[a] < rank[b]:
            a, b = b, a
        child = crossover(people[a], people[b], lengths, capacity, rng)
        made += 1
        score, worst = fitness(child, lengths, capacity), min(range(len(people)), key=rank.__getitem__)
        if score > rank[worst] and score not in rank:
            people[worst], rank[worst] = child, score
        elif made % POPULATION == 0:  # nothing new comes of these parents: the worst makes place
            people[worst] = varied(people[max(range(len(people)), key=rank.__getitem__)], lengths, capacity, rng)
            rank[worst] = fitness(people[worst], lengths, capacity)
    return people[max(range(len(people)), key=rank.__getitem__)], made


PLACED = "uid long, length int, island long, bin long, used int, open boolean, crossovers int"


def placed(t: pd.DataFrame, capacity: int, seed: int, start=None, migrants=()) -> pd.DataFrame:
    x, island = t["length"].to_numpy(), int(t["island"].iloc[0])
    owner, made = evolve(x, capacity, seed + island, start, migrants)
    used = np.bincount(owner, weights=x).astype(int)
    return pd.DataFrame({"uid": t["uid"].to_numpy(), "length": x, "island": island, "bin": owner, "used": used[owner], "open": len(used) > least_bins(x, capacity), "crossovers": made})


def islands(pieces: DataFrame, capacity: int, seed: int) -> DataFrame:
    """(uid, length) -> PLACED: epochs with migration between them, for as long as an island is open."""
    n = max(1, math.ceil(pieces.count() / ISLAND))

    def go_on(seed: int):
        def on(t: pd.DataFrame, elite: pd.DataFrame) -> pd.DataFrame:
            if not len(t):
                return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("uid", "length", "island", "bin", "used", "open", "crossovers")})
            t = t.sort_values("uid")
            return placed(t, capacity, seed, t["bin"].to_numpy(), sorted(list(map(int, p)) for p in elite["lengths"]))

        return on

    dealt = pieces.withColumn("island", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(n)))
    state = durable(dealt.groupBy("island").applyInPandas(lambda t: placed(t.sort_values("uid"), capacity, seed), PLACED), "pack-epoch")
    for epoch in range(1, EPOCHS):
        left = state.where("open")
        if left.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy("island").orderBy(F.desc("used"), F.size("lengths"), "bin"))  # an island has a bounded number of bins
        elite = state.groupBy("island", "bin", "used").agg(F.sort_array(F.collect_list("length"), False).alias("lengths"))
        elite = elite.withColumn("_n", place).where(F.col("_n") <= ELITE).select(((F.col("island") + 1) % n).alias("island"), "lengths")

        moved = left.groupBy("island").cogroup(elite.groupBy("island")).applyInPandas(go_on(seed + 1000 * epoch), PLACED)
        state = durable(state.where("not open").unionByName(moved), "pack-epoch")
    return state


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: <id_col>, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = int(LAST).to_bytes(4, "little")

    def cut(batches):
        e = encoder(tokenizer_path)
        for b in batches:
            found = [(k, j, *p) for k, t in enumerate(b.column(1)) for j, p in enumerate(pieces_of(e.ids(t.as_py() or "") + end, capacity))]
            row, number, start, length, crc = np.array(found, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["id", "piece", "start", "length", "crc"])

    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("piece int, start long, length long, crc long").fields])
    cuts = durable(rows.mapInArrow(cut, schema).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")

    short = cuts.where(F.col("length") < capacity)
    state = islands(short.select("uid", F.col("length").cast("int").alias("length")), capacity, 1)
    loose = F.col("used") < capacity - SLACK
    again = islands(state.where(loose).select("uid", "length"), capacity, 1001)
    number = lambda epoch: (F.col("island") * 2 + epoch) * ISLAND * 16 + F.col("bin")  # noqa: E731  an island has far fewer than 16 ISLAND pieces
    final = state.where(~loose).withColumn("sequence_id", number(0)).unionByName(again.withColumn("sequence_id", number(1)))
    line = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)  # at most capacity pieces
    spots = final.select(F.col("uid").alias("_u"), "sequence_id", F.coalesce(F.sum("length").over(line), F.lit(0)).alias("offset"))
    whole = cuts.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    every = short.join(spots, short["uid"] == spots["_u"]).drop("_u").unionByName(whole)
    return every.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
