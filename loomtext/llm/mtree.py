"""Exact top-k by inner product over M-trees, best first.

Vectors become integers, floor(256 x). With R the largest norm, a candidate v has one more coordinate, sqrt(R^2 - |v|^2), and a
query q a zero: then |q - v|^2 = |q|^2 + R^2 - 2 q.v is a metric that falls as the score rises, so a metric tree can prune.

1. Of equal vectors only the k + 1 smallest ids can be in an answer, so all others are folded away first, before they are dealt.
2. Candidates drawn by hash, one for about TREE_ROWS rows and MAX_PIVOTS at most, are routing objects; every vector goes to its nearest
   one. A cell that is still too large is cut into rings by the distance to its routing object, and a ring that can't be cut by
   distance is dealt by a hash. Each part is one M-tree: pages of PAGE entries, with a router, a covering radius and the distance of
   every entry to its parent's router.
3. Each query first asks the tree where it would belong, which gives a score to beat; then all trees whose ring
   leaves a chance of more. A tree answers a block of queries at once: in each round every query opens its best page by the least
   distance a page can hold, and queries that open the same page share a matrix product. A page or entry
   whose stored distance to its parent's router already shows, by the triangle inequality, that it can't reach the k-th score is
   left without computing its own distance. What remains is scored in exact integers.
4. Each tree gives at most k rows for a query; the best k of them are the answer.

Bounds are compared with a slack above rounding errors, and ties never pruned, so the result is exact; equal scores go by the
smaller id. Where the data leave nothing to prune (evenly spread vectors of many dimensions), each query meets each tree: the work is that of
the queries times the rows, what is shuffled is QUERY_BLOCK and TREE_ROWS times less.

Defined cases: vectors that are null or hold null or non-finite components take no part, as queries or as candidates; vectors of
another length than the most frequent one take no part; a query's own row isn't a candidate, nor are rows
that repeat its id; rows that repeat a query's id are one query, of the smallest of these vectors; other rows that repeat an id are
candidates each; fewer than k candidates give all of them; vectors whose scores don't fit 64 bits raise ValueError; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

PAGE, FANOUT = 256, 16
#: Rows of a tree and queries of a block, about; routing objects at most; rings of a cell at most.
TREE_ROWS, QUERY_BLOCK, MAX_PIVOTS, RINGS = 8192, 8192, 4096, 16
SCALE = 256


def slack(top: float, dims: int) -> float:
    """Distances are compared with this much to spare: their squares are sums of dims products, none above top, with rounding errors."""
    return 1e-3 + 2 * math.sqrt((dims + 8) * top * 2.0**-50)


def distances(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> np.ndarray:
    """Between rows of x and of y with their further coordinates rx and ry."""
    square = (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * (x @ y.T) + (rx[:, None] - ry[None, :]) ** 2
    return np.sqrt(np.maximum(square, 0))


class Node:
    """A page: a router, a radius that covers all below, and its entries with their distances to the router (gap).

    Entries are children (x: their routers, reach: their radii) or rows (x: the vectors), each kept side by side in memory.
    """

    __slots__ = ("children", "gap", "ids", "radius", "reach", "router", "x")

    def __init__(self, router, radius, x, gap, children=None, reach=None, ids=None):
        self.router, self.radius, self.x, self.gap, self.children, self.reach, self.ids = router, radius, x, gap, children, reach, ids


class MTree:
    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float):
        """x: float64 integers; top: the square of the largest norm of all candidates, and so of every candidate's, with its further coordinate."""
        self.ids, self.x, self.top, self.slack = ids, x, top, slack(top, x.shape[1])
        self.extra = np.sqrt(np.maximum(top - (x**2).sum(1), 0))
        self.nodes: list[Node] = []
        self.root = self.build(np.arange(len(ids)))

    def between(self, a, b) -> np.ndarray:
        return distances(self.x[a], self.x[b], self.extra[a], self.extra[b])

    def add(self, node: Node) -> int:
        self.nodes.append(node)
        return len(self.nodes) - 1

    def build(self, rows: np.ndarray) -> int:
        """Bulk load: rows go to the nearest of FANOUT spread routers until a page holds them."""
        center = self.x[rows].mean(0)
        router = rows[((self.x[rows] - center) ** 2).sum(1).argmin()]
        gap = self.between(rows, np.array([router]))[:, 0]
        if len(rows) <= PAGE:
            return self.add(Node(router, float(gap.max()), self.x[rows], gap, ids=self.ids[rows]))
        n = min(FANOUT, -(-len(rows) // PAGE))
        picked, far = [int(gap.argmax())], None
        for _ in range(n - 1):
            d = self.between(rows, rows[picked[-1:]])[:, 0]
            far = d if far is None else np.minimum(far, d)
            picked.append(int(far.argmax()))
        own = self.between(rows, rows[picked]).argmin(1)
        groups = [rows[own == k] for k in range(n) if (own == k).any()]
        if len(groups) < 2:  # equal vectors: cut by number
            groups = [rows[k : k + PAGE] for k in range(0, len(rows), PAGE)]
        children = np.array([self.build(g) for g in groups])
        below = [self.nodes[c] for c in children]
        at = np.array([c.router for c in below])
        return self.add(Node(router, float(gap.max()), self.x[at], self.between(at, np.array([router]))[:, 0], children, np.array([c.radius for c in below])))

    def search(self, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query (a row of q, with its id) the k best (score, id) of this tree that score at least `least`."""
        m, whole = len(q), (q**2).sum(1) + self.top  # the square of a distance is this less twice the score
        limit = lambda r, s: np.sqrt(np.maximum(whole[r] - 2 * s, 0)) + self.slack  # noqa: E731  no further than this
        with np.errstate(invalid="ignore"):
            reach = np.where(np.isinf(least), np.inf, limit(np.arange(m), np.where(np.isinf(least), 0, least)))
        exact, near_enough = self.top < 2.0**52, 0.5 + self.top * len(q[0]) * 2.0**-52
        floor, best = least.copy(), [[] for _ in range(m)]  # heaps of (score, -id)
        bound, far = np.full((m, len(self.nodes)), np.inf), np.zeros((m, len(self.nodes)))  # of pages still to open: the least distance below, and that of the router
        far[:, self.root] = np.sqrt(np.maximum(whole - 2 * (q @ self.x[self.nodes[self.root].router]), 0))
        bound[:, self.root] = far[:, self.root] - self.nodes[self.root].radius
        active = np.arange(m)
        while len(active):
            page = bound[active].argmin(1)
            low = bound[active, page]
            go = (low <= reach[active]) & (low < np.inf)
            active, page = active[go], page[go]
            bound[active, page] = np.inf
            order = np.argsort(page, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(page[order])) + 1) if len(order) else ():
                node, rows = self.nodes[page[some[0]]], active[some]
                gap = np.abs(far[rows, page[some[0]]][:, None] - node.gap[None, :])
                near = gap - (0 if node.reach is None else node.reach) <= reach[rows][:, None] + self.slack
                at = np.flatnonzero(near.any(0))
                if not len(at):
                    continue
                scores = q[rows] @ node.x[at].T
                if node.children is not None:
                    d = np.sqrt(np.maximum(whole[rows][:, None] - 2 * scores, 0))
                    cell = np.ix_(rows, node.children[at])
                    far[cell], bound[cell] = d, np.where(near[:, at], d - node.reach[at], np.inf)
                    continue
                ids = node.ids[at]
                hits = near[:, at] & (scores >= floor[rows][:, None] - near_enough) & (ids[None, :] != own[rows][:, None])
                for j in np.flatnonzero(hits.any(1)).tolist():
                    r, found = rows[j], np.flatnonzero(hits[j])
                    values = np.rint(scores[j, found]).astype(np.int64).tolist() if exact else [sum(int(a) * int(b) for a, b in zip(q[r], node.x[at[c]], strict=True)) for c in found]
                    heap = best[r]
                    for s, i in zip(values, ids[found].tolist(), strict=True):
                        if s < least[r]:
                            continue
                        if len(heap) < k:
                            heapq.heappush(heap, (s, -i))
                        elif (s, -i) > heap[0]:
                            heapq.heapreplace(heap, (s, -i))
                    if len(heap) == k:
                        floor[r] = max(floor[r], heap[0][0])
                        reach[r] = min(reach[r], limit(r, floor[r]))
        return [[(s, -i) for s, i in heap] for heap in best]


def quantised(vectors: DataFrame, is_query, id_col: str, vector_col: str) -> DataFrame:
    """(id, q, v array<long>) of the vectors that take part, native."""
    x = F.col(vector_col)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), scaled.alias("v"))


def matrix(column, dims: int) -> np.ndarray:
    """Vectors kept as bytes."""
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, dims)


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def folded(rows: DataFrame, k: int) -> DataFrame:
    """Candidates that can be in an answer: of equal vectors, those of the k + 1 smallest ids, and of rows that repeat that too, k. Each task cuts before it shuffles."""
    by = [F.xxhash64("v"), F.col("v")]
    kept = rows.withColumn("_n", F.dense_rank().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("_n") <= k + 1)
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "id").orderBy("id"))).where(F.col("_n") <= k).select("id", "v")


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, <id_col>, score. is_query: a boolean column of the table."""
    spark = vectors.sparkSession
    rows = durable(quantised(vectors, is_query, id_col, vector_col), "mtree-vectors")
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())])
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], out)
    dims = length["n"]
    rows = rows.where(F.size("v") == dims)
    top = float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).first()[0]) * (1 + 1e-9)
    if top >= 2.0**62:
        raise ValueError("scores of these vectors don't fit 64 bits")
    kept = durable(folded(rows, k), "mtree-rows")
    count = min(MAX_PIVOTS, max(1, math.ceil(kept.count() / TREE_ROWS)))
    some = np.array([r["v"] for r in kept.orderBy(F.xxhash64("id"), "v").limit(count).select("v").collect()], np.float64).reshape(-1, dims)  # MAX_PIVOTS at most
    extra = np.sqrt(np.maximum(top - (some**2).sum(1), 0))
    spare = slack(top, dims)

    def to_routes(x, candidates: bool):
        return distances(x, some, np.sqrt(np.maximum(top - (x**2).sum(1), 0)) if candidates else np.zeros(len(x)), extra)

    def route(batches):
        for b in batches:
            for part in (b.slice(at, 1024) for at in range(0, len(b), 1024)):
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dims)
                d = to_routes(x, True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))], names=["id", "x", "cell", "d"])

    cells = durable(kept.mapInArrow(route, "id long, x binary, cell int, d double"), "mtree-cells")
    # rings of about equal numbers, and the parts of those that are too large still
    edges = cells.groupBy("cell").agg(F.least(F.lit(RINGS), F.ceil(F.count(F.lit(1)) / TREE_ROWS)).cast("int").alias("rings"), F.percentile_approx("d", [j / RINGS for j in range(1, RINGS)], 1000).alias("p"))
    edges = edges.select("cell", F.when(F.col("rings") > 1, F.transform(F.sequence(F.lit(1), F.col("rings") - 1), lambda j: F.element_at("p", F.floor(j * RINGS / F.col("rings")).cast("int")))).otherwise(F.array().cast("array<double>")).alias("edges"))
    ringed = cells.join(F.broadcast(edges), "cell").select("id", "x", "d", "cell", F.size(F.filter("edges", lambda e: e < F.col("d"))).alias("ring"))  # MAX_PIVOTS rows at most
    ringed = durable(ringed, "mtree-rings")
    rings = ringed.groupBy("cell", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.ceil(F.count(F.lit(1)) / TREE_ROWS).cast("long").alias("parts")).orderBy("cell", "ring").collect()  # MAX_PIVOTS * RINGS at most
    cell, low, high, parts = (np.array([r[c] for r in rings]) for c in ("cell", "low", "high", "parts"))
    first = np.cumsum(parts) - parts  # number of a ring's first tree
    numbers = spark.createDataFrame([(r["cell"], r["ring"], int(f), r["parts"]) for r, f in zip(rings, first, strict=True)], "cell int, ring int, first long, parts long")
    trees = ringed.join(F.broadcast(numbers), ["cell", "ring"]).select("id", "x", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("tree"))

    def belongs(batches):
        """Each query to a tree of the nearest routing object, of the ring that is nearest there."""
        for b in batches:
            for part in (b.slice(at, 256) for at in range(0, len(b), 256)):
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dims)
                d, ids = to_routes(x, False), part.column(0).to_numpy()
                own = d[:, cell]
                away = np.maximum(np.maximum(low - own, own - high), 0) + np.where(cell[None, :] == d.argmin(1)[:, None], 0.0, np.inf)
                ring = away.argmin(1)
                tree = first[ring] + ids % parts[ring]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.nulls(len(x), pa.float64()), pa.array(tree.tolist(), pa.int64()), pa.array([[t] for t in tree.tolist()], pa.list_(pa.int64()))], names=["id", "x", "least", "own", "trees"])

    def others(batches):
        """The trees that may hold at least `least` and weren't asked yet."""
        step = max(1, 4_000_000 // max(1, int(parts.sum())))
        for b in batches:
            for part in (b.slice(at, step) for at in range(0, len(b), step)):
                x = matrix(part.column(1).to_pylist(), dims)
                own = to_routes(x, False)[:, cell]
                least = part.column(2).to_numpy(zero_copy_only=False)
                reach = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum((x**2).sum(1) + top - 2 * np.nan_to_num(least), 0)) + 2 * spare)
                go = np.maximum(low - own, own - high) <= reach[:, None]
                lists = [[t for r in np.flatnonzero(g).tolist() for t in range(first[r], first[r] + parts[r]) if t != o] for g, o in zip(go, part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(lists, pa.list_(pa.int64()))], names=["id", "x", "least", "own", "trees"])

    sent = "id long, x binary, least double, own long, trees array<long>"

    def answer(tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(tree) and len(queries):
            t = MTree(tree["id"].to_numpy(), matrix(tree["x"], dims), top)
            least = np.where(queries["least"].isna(), -np.inf, queries["least"].to_numpy(np.float64))
            ids = queries["id"].to_numpy()
            for i, found in zip(ids.tolist(), t.search(matrix(queries["x"], dims), ids, k, least), strict=True):
                got += [(i, j, s) for s, j in found]
        return pd.DataFrame(got, columns=["query_id", "id", "score"]).astype("int64")

    def ask(questions: DataFrame) -> DataFrame:
        """Trees against blocks of the queries that go to them; a tree is dealt again only for each QUERY_BLOCK of these."""
        asked = questions.select("id", "x", "least", F.explode("trees").alias("tree"))
        blocks = asked.groupBy("tree").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("long").alias("blocks"))
        asked = asked.join(blocks, "tree").select("tree", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "x", "least")
        own = trees.join(blocks, "tree").select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "x")
        return durable(own.groupBy("tree", "block").cogroup(asked.groupBy("tree", "block")).applyInPandas(answer, "query_id long, id long, score long"), "mtree-found")

    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    queries = durable(queries.mapInArrow(belongs, sent), "mtree-queries")
    near = ask(queries)
    least = ranked(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("s"))
    rest = queries.join(least, "id", "left").select("id", "x", F.col("s").alias("least"), "own", "trees")
    rest = ask(durable(rest.mapInArrow(others, sent), "mtree-sent"))
    return ranked(near.unionByName(rest), k).select("query_id", "rank", F.col("id").alias(id_col), "score")
