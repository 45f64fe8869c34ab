"""N-gram Jaccard join over count-vector R-trees.

A document's set is its distinct word shingles, as 64-bit hashes; two documents link when their Jaccard similarity is at least
num / den. A set's point has GROUPS coordinates, or more for a long set: how many of its shingles each hash group holds. No two sets share more than the
sum of the coordinate minima of their points; an R-tree over points bounds whole pages the same way, by their coordinate maxima.

1. Equal sets are one node from here on, whatever the number of copies.
2. A node is dealt to groups by the prefix of its set: with num / den, two linked sets share a shingle among the first
   n - ceil(num n / den) + 1 of any common order, so each linked pair meets. The order is that of how many shingles of all documents the
   shingle's hash group holds (2^SKETCH groups, so the table has a fixed size): what many documents share comes last.
3. In each group an R-tree is searched with each point; what survives the bound joins a forest of candidates, so a
   group of m near copies gives m - 1 links and not m (m - 1) / 2.
4. The candidates' components hold every true link. Their sets are built once more from the whole texts (found with a Bloom filter
   of fixed size, then joined exactly), searched by an R-tree again, and every surviving pair that could still join two
   components is verified by counting common shingles.
   If the number of links is asked for, the same tasks verify all pairs of each component instead, each pair in one task.
5. Connected components of the verified links, without collecting any of them.

Groups above GROUP points of GROUPS coordinates and components above BLOCK shingles are searched in blocks, in two rounds (`in_rounds`):
each block with the same representatives, which joins a family of near copies whole; then only what isn't in the largest part
against every block. So the work is linear in the size of a family, and a product only of what is left outside with the whole.
With the number of links asked for, all pairs of blocks are searched, as each pair counts.

Shingles are compared as 64-bit hashes (of polynomial hashes of their words): different shingles of equal hash count as one, which among the
few thousand shingles of two documents has a chance of less than 1 in 10^12.

Defined cases: a text that is null or has no words has an empty set and links with nothing; a text of fewer words than a shingle is
one shingle; rows with equal text are linked; a null id takes part, and a component's name is the smallest id that isn't null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable
from .components import components

#: Shingle words and similarity unless said otherwise.
WORDS, NUM, DEN = 5, 80, 100
GROUPS, SKETCH = 64, 20
#: Points of GROUPS coordinates (a finer point counts as several) searched by one task; groups up to SMALL are compared as lists of members, so that equal lists are searched once.
GROUP, SMALL = 4096, 64
#: Shingles of a component that one task holds, and bits of the Bloom filter.
BLOCK, BLOOM = 4_000_000, 1 << 26
PAGE, FANOUT = 32, 16

_LUT = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LUT[_SPACE] = 0
_LUT[ord("A") : ord("Z") + 1] = _LUT[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _BASE, np.uint64))])
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; ASCII letters lower-cased, words parted by ASCII white space."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~_SPACE[b]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    b = b[starts[0] :]
    starts = starts - starts[0]
    width = np.diff(np.append(starts, len(b)))
    place = np.arange(len(b)) - np.repeat(starts, width)
    w = _mixed(np.add.reduceat(_LUT[b] * _power(int(width.max()))[place], starts))
    k = min(words, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = h * _BASE + w[j : n - k + 1 + j]
    return np.unique(_mixed(h))


def need(n, m, num: int, den: int):
    """Least number of common shingles of linked sets of n and m."""
    return -(-num * (n + m) // (num + den))


def point(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def fine_point(s: np.ndarray) -> np.ndarray:
    """A point of GROUPS coordinates, doubled until there is one for 16 shingles: between long sets, few coordinates tell little apart."""
    groups = GROUPS
    while 16 * groups < len(s):
        groups *= 2
    return point(s, groups).astype("<u4")


def folded(v: np.ndarray, groups: int) -> np.ndarray:
    """The same set's point in fewer hash groups."""
    return v.reshape(-1, groups).sum(0, dtype=np.int64)


class CountTree:
    """R-tree of count vectors, bulk loaded by set size. A page keeps its coordinate maxima and the smallest set size below it."""

    def __init__(self, n: np.ndarray, v: np.ndarray, num: int, den: int):
        self.n, self.v, self.num, self.den = n, v, num, den
        self.levels = []
        order = np.lexsort((v[:, 0], n))
        self.order = order
        low, high = n[order], v[order]
        size = PAGE
        while len(low) > size:
            first = np.arange(0, len(low), size)
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first, axis=0)
            self.levels.append((size, low, high))
            size = FANOUT

    def candidates(self, q: int, alive: np.ndarray) -> np.ndarray:
        """Places of the sets that are alive and that the bound lets link with set q."""
        n, v, keep = self.n[q], self.v[q], None
        for k in range(len(self.levels) - 1, -1, -1):
            size, low, high = self.levels[k]
            at = np.arange(len(low)) if keep is None else keep
            at = at[np.minimum(high[at], v).sum(1) >= need(low[at], n, self.num, self.den)]
            keep = (at[:, None] * size + np.arange(size)).ravel()
            keep = keep[keep < (len(self.n) if k == 0 else len(self.levels[k - 1][1]))]
        rows = self.order if keep is None else self.order[keep]
        rows = rows[alive[rows]]
        return rows[np.minimum(self.v[rows], v).sum(1) >= need(self.n[rows], n, self.num, self.den)]


def forest(n: np.ndarray, v: np.ndarray, num: int, den: int, verify=None) -> list[tuple[int, int]]:
    """Links that join all that the bound (and verify(q, rows) -> mask) links, each found once: a spanning forest."""
    tree, alive, out = CountTree(n, v, num, den), np.ones(len(n), bool), []
    for seed in range(len(n)):
        if not alive[seed]:
            continue
        alive[seed], stack = False, [seed]
        while stack:
            q = stack.pop()
            rows = tree.candidates(q, alive)
            if verify is not None and len(rows):
                rows = rows[verify(q, rows)]
            alive[rows] = False
            out += [(q, r) for r in rows.tolist()]
            stack += rows.tolist()
    return out


def all_links(s: list, num: int, den: int, most: int = 2_000_000):
    """(first, mask) for runs of sets: mask[k] says which sets link with set first + k, itself among them.

    Common shingles of all pairs: those of many sets by a matrix product, all others by the lists of sets that hold them.
    """
    m, n = len(s), np.array([len(x) for x in s], np.int64)
    _, column, held = np.unique(np.concatenate(s), return_inverse=True, return_counts=True)
    owner, frequent = np.repeat(np.arange(m), n), held > max(16, m // 4)
    number = np.cumsum(frequent) - 1
    dense = np.zeros((m, int(frequent.sum())), np.float32)
    at = frequent[column]
    dense[owner[at], number[column[at]]] = 1
    lists, start = owner[np.argsort(column, kind="stable")], np.cumsum(held) - held
    size, row = np.where(at, 0, held[column]), np.cumsum(n) - n
    cost = np.cumsum(m + np.add.reduceat(size, row))
    first = 0
    while first < m:
        end = max(first + 1, int(np.searchsorted(cost, (cost[first - 1] if first else 0) + most, "right")))
        common = (dense[first:end] @ dense.T).astype(np.int64)
        span = np.arange(row[first], row[end - 1] + n[end - 1])
        span = span[size[span] > 0]
        for part in np.split(span, np.searchsorted(np.cumsum(size[span]), np.arange(most, int(size[span].sum()), most))):
            k = size[part]
            place = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[column[part]], k)
            flat = np.repeat(owner[part] - first, k) * m + lists[place]
            common += np.bincount(flat, minlength=(end - first) * m).reshape(end - first, m)
        yield first, den * common >= num * (n[first:end, None] + n[None, :] - common)
        first = end


def chunks(batches, *columns, most: int = 2_000_000):
    """Lists of the columns' values, cut so that the last column's texts have about `most` characters together."""
    for b in batches:
        values, start, size = [b.column(c).to_pylist() for c in columns], 0, 0
        for k, t in enumerate(values[-1]):
            size += len(t or "")
            if size >= most or k == len(values[-1]) - 1:
                yield b.slice(start, k + 1 - start), [v[start : k + 1] for v in values]
                start, size = k + 1, 0


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """The number of distinct shingles of documents, over all documents, in each of 2^SKETCH hash groups."""
    slices, shift = 256, np.uint64(64 - SKETCH)

    def count(batches):
        total = np.zeros(1 << SKETCH, np.int64)
        for _, (texts,) in chunks(batches, 0):
            found = [shingles(t, words) for t in texts]
            total += np.bincount((np.concatenate(found) >> shift).astype(np.int64), minlength=1 << SKETCH)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in np.split(total, slices)], pa.binary())], names=["k", "c"])

    def add(batches):
        sums: dict = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(c, "<i8")
                sums[k] = sums[k] + x if k in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["k", "c"])

    parts = docs.select("text").mapInArrow(count, "k int, c binary").repartition("k").mapInArrow(add, "k int, c binary").collect()  # 2^SKETCH numbers, whatever the input
    total = np.zeros((slices, (1 << SKETCH) // slices), np.int64)
    for r in parts:
        total[r["k"]] = np.frombuffer(bytes(r["c"]), "<i8")
    return np.minimum(total.ravel(), 2**32 - 1).astype(np.uint32)


def prefix(s: np.ndarray, load: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles by which a set is dealt to groups: those of the least filled hash groups, then by hash."""
    k = len(s) - -(-num * len(s) // den) + 1
    return s[np.argsort(load[(s >> np.uint64(64 - SKETCH)).astype(np.int64)], kind="stable")[:k]]


def runs(batches, keys: int):
    """Whole groups of rows that come sorted by their first `keys` columns: (key, record batch)."""
    held: list = []
    last = None
    for b in batches:
        if not len(b):
            continue
        k = np.stack([c.to_numpy() for c in b.columns[:keys]], 1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
            key = tuple(k[s].tolist())
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


LINK = "u long, v long"


def _links(found: list) -> pa.RecordBatch:
    u, v = np.array(found, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def in_blocks(groups: DataFrame, blocks, node: str) -> DataFrame:
    """Adds i, j: a row of a group of `blocks` blocks goes to every pair of its block and another; a group of one block is the pair 0, 0."""
    own = F.pmod(F.xxhash64(node, F.lit(7)), blocks).cast("int")
    pairs = F.transform(F.filter(F.sequence(F.lit(0), (blocks - 1).cast("int")), lambda k: (k != own) | (blocks == 1)), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    return groups.withColumn("_pair", F.explode(pairs)).withColumn("i", F.col("_pair.i")).withColumn("j", F.col("_pair.j")).drop("_pair")


def dealt(groups: DataFrame) -> DataFrame:
    return groups.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def in_rounds(rows: DataFrame, most: int, find) -> DataFrame:
    """Links that join all that `find` links within the groups, for groups too large for one task.

    rows: g, node, w (weight), total (the group's weight, above `most`) and what find needs, a function for mapInArrow over rows sorted by g, i, j.
    """
    blocks = F.ceil(F.col("total") / most).cast("int")
    place = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    chosen = place(blocks * 4, 8) == 0  # about a quarter of a block's weight
    first = rows.withColumn("i", F.explode(F.when(chosen, every(blocks)).otherwise(F.array(place(blocks, 7))))).withColumn("j", F.lit(0))
    found = durable(dealt(first).mapInArrow(find, LINK), "round-links")
    named = rows.select("g", "node", "w").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = durable(named, "round-names")
    parts = named.groupBy("g", "root").agg(F.sum("w").alias("w")).groupBy("g").agg(F.max(F.struct("w", "root")).alias("m"), F.sum("w").alias("all"))
    parts = durable(parts.where(F.col("all") > F.col("m.w")).select("g", F.col("m.root").alias("major"), F.ceil((F.col("all") - F.col("m.w")) / most).cast("int").alias("rest")), "round-parts")
    if parts.isEmpty():
        return found
    minor = named.join(parts, "g").where(F.col("root") != F.col("major")).select("g", "node")
    left = rows.join(parts.select("g", "rest"), "g")
    whole = left.withColumn("i", F.explode(every(F.col("rest")))).withColumn("j", place(blocks, 7))
    some = left.join(minor, ["g", "node"], "left_semi").withColumn("i", place(F.col("rest"), 9)).withColumn("j", F.explode(every(blocks)))
    return found.unionByName(durable(dealt(whole.unionByName(some.select(*whole.columns))).mapInArrow(find, LINK), "round-links"))


def bloom_of(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of BLOOM bits, whatever the number of hashes (column h): two bits for each, set by aggregation; at most BLOOM / 32 rows are collected."""
    bits = hashes.select(F.explode(F.array("h", F.xxhash64("h"))).alias("h")).select(F.pmod("h", F.lit(BLOOM)).alias("b"))
    words = bits.groupBy(F.floor(F.col("b") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b % 32))")).alias("x")).toArrow()
    bloom = np.zeros(BLOOM // 32, np.uint32)
    bloom[words.column("w").to_numpy()] = words.column("x").to_numpy().astype(np.uint32)
    return bloom


def in_bloom(bloom: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the rows: h and xxhash64(h) of each."""
    at = [h % BLOOM for h in hashes]
    return np.logical_and.reduce([(bloom[a >> 5] >> (a & 31).astype(np.uint32) & np.uint32(1)) == 1 for a in at])


def without(docs: DataFrame, dropped: DataFrame, key) -> DataFrame:
    """The rows of docs whose key (a column) isn't in dropped (column key). Only rows that a Bloom filter of dropped may hold are shuffled."""
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(dropped.select(F.xxhash64("key").alias("h"))))
    keyed = docs.withColumn("_key", key).select(F.xxhash64("_key").alias("_h"), F.xxhash64(F.xxhash64("_key")).alias("_h2"), "_key", *docs.columns)

    def flag(batches):
        for b in batches:
            may = in_bloom(bloom.value, b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(may), *b.columns[2:]], names=["_may", *b.schema.names[2:]])

    flagged = keyed.mapInArrow(flag, T.StructType([T.StructField("_may", T.BooleanType()), *keyed.schema.fields[2:]]))
    rest = flagged.where("_may").join(dropped.select(F.col("key").alias("_dropped")), F.col("_key") == F.col("_dropped"), "left_anti")
    return flagged.where("not _may").select(*docs.columns).unionByName(rest.select(*docs.columns))


def near_duplicates(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """One row per input row: <id_col>, n_shingles, component_id (the smallest id that links reach).

    links: also n_links, the number of other rows that the row links with, its copies and theirs counted; this verifies every pair of a component.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    load = spark.sparkContext.broadcast(sketch(rows, words))

    def read(batches):
        filled = load.value
        for part, (texts,) in chunks(batches, 1):
            sets = [shingles(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([fine_point(s).tobytes() for s in sets], pa.binary()), pa.array([prefix(s, filled, num, den).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                names=["id", "n", "digest", "vec", "sigs"],
            )

    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("n long, digest binary, vec binary, sigs array<long>").fields])
    members = durable(rows.mapInArrow(read, schema), "join-members")
    nodes = members.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("vec").alias("vec"), F.first("sigs").alias("sigs"), *([F.count(F.lit(1)).alias("copies")] if links else []))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()), "join-nodes")

    # groups of nodes that share a shingle of their prefixes; sizes are summed in the tasks first, and found again by a join that may split a hot shingle
    meet = nodes.select("node", (F.octet_length("vec") / (4 * GROUPS)).cast("long").alias("w"), F.explode("sigs").alias("sig"))
    sizes = meet.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.sum("w").alias("total")).where("size > 1")
    meet = durable(meet.join(sizes, "sig"), "join-meet")
    one = F.col("total") <= GROUP
    lists = meet.where(one & (F.col("size") <= SMALL)).groupBy("sig").agg(F.sort_array(F.collect_list("node")).alias("m")).select("m").distinct()
    lists = lists.withColumn("g", F.monotonically_increasing_id()).select("g", F.explode("m").alias("node"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    middle = meet.where(one & (F.col("size") > SMALL)).select(F.col("sig").alias("g"), "node", F.lit(0).alias("i"), F.lit(0).alias("j"))
    points = nodes.select("node", "n", "vec")
    groups = durable(lists.unionByName(middle), "join-groups").join(points, "node").select("g", "i", "j", "node", "n", "vec")
    large = meet.where(~one).select(F.col("sig").alias("g"), "node", "w", "total")
    large = None if large.isEmpty() else durable(large.join(points, "node").select("g", "node", "w", "total", "n", "vec"), "join-large")

    def bound(batches):
        found = []
        for _, t in runs((b.select(["g", "i", "j", "node", "n", "vec"]) for b in batches), 3):
            node, first = np.unique(t.column("node").to_numpy(), return_index=True)  # a node may come twice to a block
            t = t.take(pa.array(first))
            n = t.column("n").to_numpy()
            fine = [np.frombuffer(x, "<u4") for x in t.column("vec").to_pylist()]
            v = np.stack([folded(x, GROUPS) for x in fine])

            def closer(q, rows, fine=fine, n=n):
                """The same bound in as many coordinates as both points have."""
                ok = np.ones(len(rows), bool)
                for k, r in enumerate(rows):
                    g = min(len(fine[q]), len(fine[r]))
                    if g > GROUPS:
                        ok[k] = np.minimum(folded(fine[q], g), folded(fine[r], g)).sum() >= need(n[q], n[r], num, den)
                return ok

            found += [(node[a], node[b]) for a, b in forest(n, v, num, den, closer)]
            if len(found) > 50_000:
                yield _links(found)
                found = []
        if found:
            yield _links(found)

    pairs = dealt(groups).mapInArrow(bound, LINK)
    candidates = components(pairs.unionByName(in_rounds(large, GROUP, bound)) if large else pairs)

    # the candidates' sets, from their whole texts
    named = candidates.withColumnRenamed("root", "comp").union(candidates.select("root", "root").distinct()).toDF("node", "comp")
    named = durable(named.join(nodes.select("node", "digest", "id", "n", *(["copies"] if links else [])), "node"), "join-candidates")
    blocks = durable(named.groupBy("comp").agg(F.sum("n").alias("total")), "join-components").withColumn("blocks", F.ceil(F.col("total") / BLOCK))
    split = not links and not blocks.where("blocks > 1").isEmpty()
    bloom = spark.sparkContext.broadcast(bloom_of(named.select(F.xxhash64("id").alias("h"))))

    def rebuild(batches):
        for b in batches:
            keep = in_bloom(bloom.value, b.column(0).to_numpy(), b.column(1).to_numpy())
            b = pa.RecordBatch.from_arrays([b.column(2).filter(pa.array(keep))], names=["text"])
            for _, (texts,) in chunks([b], 0):
                sets = [s for t in texts if len(s := shingles(t, words))]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "set"])

    sets = rows.select(F.xxhash64("id").alias("h"), F.xxhash64(F.xxhash64("id")).alias("h2"), "text").mapInArrow(rebuild, "digest binary, set binary")
    sets = named.join(blocks, "comp").join(sets.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d")).withColumnRenamed("comp", "g")
    big = durable(sets.where("blocks > 1").select("g", "node", F.col("n").alias("w"), "total", "set"), "join-big") if split else None
    if links:
        own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int").alias("own")
        sets = in_blocks(sets, F.col("blocks"), "node").select("g", "i", "j", "node", "set", own, "copies")
    else:
        sets = sets.where("blocks = 1").select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "set")

    def exact(batches):
        for _, t in runs((b.select(["g", "i", "j", "node", "set"]) for b in batches), 3):
            node, first = np.unique(t.column("node").to_numpy(), return_index=True)  # rows that repeat a set were rebuilt each
            data = t.column("set").take(pa.array(first)).to_pylist()
            s = [np.frombuffer(x, np.uint64) for x in data]
            n, v = np.array([len(x) for x in s], np.int64), np.stack([point(x) for x in s])

            def verify(q, found, s=s, n=n):
                other = np.concatenate([s[r] for r in found])
                at = np.minimum(np.searchsorted(s[q], other), n[q] - 1)
                common = np.add.reduceat((s[q][at] == other).astype(np.int64), np.concatenate([[0], np.cumsum(n[found])[:-1]]))
                return den * common >= num * (n[q] + n[found] - common)

            if links := forest(n, v, num, den, verify):
                yield _links([(node[a], node[b]) for a, b in links])

    def counted(batches):
        """Rows (u, v, 0), links that join all that link, and (node, null, weight of the sets that it links with)."""
        for (_, i, j), t in runs(batches, 3):
            node, first = np.unique(t.column("node").to_numpy(), return_index=True)
            t = t.take(pa.array(first))
            s = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            own, copies = t.column("own").to_numpy(), t.column("copies").to_numpy()
            inside = (i == j) | ((i == 0) & ((own == j) | (j == 1)))  # whether pairs within a block are this task's
            label, total, found = np.arange(len(s)), np.zeros(len(s), np.int64), []
            for start, mask in all_links(s, num, den):
                mask &= (own[start : start + len(mask), None] != own[None, :]) | inside[None, :]
                mask[np.arange(len(mask)), start + np.arange(len(mask))] = False
                total[start : start + len(mask)] = mask @ copies
                for q, with_q in enumerate(mask, start):
                    others, at = np.unique(label[r := np.flatnonzero(with_q)], return_index=True)
                    new = others != label[q]
                    if new.any():
                        found += [(q, x) for x in r[at[new]].tolist()]
                        label[np.isin(label, others)] = label[q]
            u, v = np.array(found, np.int64).reshape(-1, 2).T
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[u], node[some]])), pa.array([*node[v].tolist(), *[None] * len(some)], pa.int64()), pa.array(np.concatenate([np.zeros(len(u), np.int64), total[some]]))],
                names=["u", "v", "w"],
            )

    if links:
        pairs = durable(dealt(sets).mapInArrow(counted, f"{LINK}, w long"), "join-links")
        linked = components(pairs.where("v is not null").select("u", "v"))
    else:
        pairs = dealt(sets).mapInArrow(exact, LINK)
        linked = components(pairs.unionByName(in_rounds(big, BLOCK, exact)) if split else pairs)
    root = nodes.select("node", "id", "digest").join(linked, "node", "left").select("digest", "id", F.coalesce("root", "node").alias("root"))
    root = durable(root, "join-roots")
    least = root.groupBy("root").agg(F.min("id").alias("component_id"))
    names = root.join(least, "root").select("digest", "component_id")
    more = []
    if links:
        number = pairs.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("w"))
        number = nodes.select("node", "digest", "copies").join(number, "node", "left").select("digest", (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        names, more = names.join(number, "digest"), [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    return members.select("id", "n", "digest").join(names, "digest", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), *more)
