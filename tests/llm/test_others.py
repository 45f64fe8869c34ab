"""Top-k, chat formatting and the pipeline."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import chat, language_id, mtree, queries
from loomtext.llm.common import durable

from .data import SMALL, documents, empty, odd


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    found = queries.Q[name](spark, SMALL)
    assert sorted(map(tuple, found.collect())) == sorted(c.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.SQL[name]})").fetchall())


def test_top_k_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)] + [(None, [1.0] * 4), (501, None), (502, [1.0, None, 0.0, 0.0]), (503, [float("nan")] * 4), (504, [float("inf")] * 4), (505, []), (506, [1.0]), (0, rows[0][1])]
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, score long, cell string")
    found = defaultdict(list)
    for r in mtree.top_k(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows[:500]]
    for i, q in good[::20]:
        assert found[i] == [(s, j) for s, j in sorted(((int(q @ v), j) for j, v in good if j != i), key=lambda x: (-x[0], x[1]))[:5]]
    assert mtree.top_k(table.limit(0), F.lit(True)).count() == 0
    assert mtree.top_k(table.where("vec_id in (20, 21, 22)"), F.col("vec_id") == 20).count() == 2


@pytest.mark.parametrize("scale", [256, 2.0**24])
def test_tree_is_exact(scale):
    """In blocks of queries, with and without a score to beat; also where scores need more than a double's 53 bits."""
    rng = np.random.default_rng(4)
    x = np.floor(scale * rng.normal(size=(1500, 8)))
    x[700:1000] = x[700] + rng.integers(0, 3, (300, 8))
    t = mtree.MTree(np.arange(1500), x, float((x**2).sum(1).max()) * (1 + 1e-9))
    q = np.arange(0, 1500, 11)
    exact = x.astype(np.int64).astype(object)
    s = exact[q] @ exact.T
    want = [sorted(((int(s[a, j]), j) for j in range(1500) if j != i), key=lambda p: (-p[0], p[1]))[:5] for a, i in enumerate(q)]
    by = lambda found: [sorted(f, key=lambda p: (-p[0], p[1])) for f in found]
    assert by(t.search(x[q], q, 5, np.full(len(q), -np.inf))) == want
    if scale == 256:
        assert by(t.search(x[q], q, 5, np.array([float(w[2][0]) for w in want]))) == [[p for p in w if p[0] >= w[2][0]] for w in want]


def test_tree_leaves_pages_closed(monkeypatch):
    """Clustered vectors: most pages are never opened."""
    monkeypatch.setattr(mtree, "PAGE", 32)
    rng = np.random.default_rng(8)
    x = np.floor(256 * (np.repeat(rng.normal(size=(64, 16)) * 8, 64, 0) + rng.normal(size=(4096, 16)) * 0.05))
    t = mtree.MTree(np.arange(4096), x, float((x**2).sum(1).max()) * (1 + 1e-9))
    opened = []
    real = np.split
    monkeypatch.setattr(mtree.np, "split", lambda *a: opened.append(len(a[0])) or real(*a))
    t.search(x[:1], np.arange(1), 5, np.full(1, -np.inf))
    assert sum(opened) < len(t.nodes) / 3


def test_top_k_in_small_trees(spark, monkeypatch):
    """Many routing objects, rings, hashed parts and blocks; a vector that a third of the rows share; ids that repeat."""
    for name, n in (("TREE_ROWS", 40), ("QUERY_BLOCK", 3), ("MAX_PIVOTS", 4), ("RINGS", 3), ("PAGE", 8)):
        monkeypatch.setattr(mtree, name, n)
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=4).round(2)]) for i in range(400)] + [(i, [0.5, -0.25, 0.5, 0.0]) for i in range(400, 600)] + [(20, [9.0, 9.0, 9.0, 9.0]), (401, [0.5, -0.25, 0.5, 0.0])] + [(777, [3.0, 3.0, 3.0, 3.0])] * 9
    found = defaultdict(list)
    for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].append((r.rank, r.score, r.vec_id))
    v = [(i, np.floor(256 * np.array(x)).astype(int)) for i, x in rows]
    queries = {}
    for i, x in v:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, x.tolist()), x.tolist())
    for i, q in queries.items():
        want = sorted(((int(np.array(q) @ x), j) for j, x in v if j != i), key=lambda p: (-p[0], p[1]))[:5]
        assert sorted(found[i]) == [(n + 1, *w) for n, w in enumerate(want)]


def test_top_k_beyond_64_bits(spark):
    with pytest.raises(ValueError, match="64 bits"):
        mtree.top_k(spark.createDataFrame([(1, [1e9, 1e9]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), F.lit(True))


ODD = [
    (1, 0, "system", "be <|end|> nice"), (1, 1, "user", "hi\n<|turn|>assistant\n"), (1, 2, "assistant", "\x1a1 \x1a <|x|> [INST] <<SYS>>"), (1, 3, "assistant", None), (1, 4, None, ""), (1, 4, None, ""),
    (2, None, "user", "no number"), (2, -100, "assistant", "before"), (2, 5, "assistant", "w " * 3000), (None, 1, "assistant", "no conversation"), (3, 1, "sys\ntem", "role with a line"),
]


@pytest.mark.parametrize("limits", [{}, {"budget": 60, "history": 25}, {"budget": 3, "history": 0}])
@pytest.mark.parametrize("make", ["table", "odd", "long"])
def test_chat_round_trip(spark, limits, make):
    if make == "table":
        turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    else:
        rows = ODD if make == "odd" else [(9, t, ("user", "assistant")[t % 2], f"turn {t} says this") for t in range(200)]
        turns = spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, span long, window string")
    by = defaultdict(list)
    for r in turns.collect():
        by[r.conv_id].append((-(10**9) if r.turn is None else r.turn, r.role or "", r.text or ""))
    windows = chat.chat_windows(turns, **limits)
    found = {r.conv_id: r for r in chat.chat_digests(windows).collect()}
    assert set(found) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, said in by.items():
        said.sort()
        lost = "".join(t for _, role, t in said if role == "assistant")
        assert (found[conv].n_turns, found[conv].turns_sha256, found[conv].loss_chars, found[conv].loss_sha256) == (len(said), sha("".join(f"{r}\n{t}\n" for _, r, t in said)), len(lost), sha(lost))
    for w in windows.collect():
        assert w.formatted.count("<|turn|>") == w.formatted.count("<|end|>") == w.n_new + w.n_repeated
        assert w.tokens <= limits.get("budget", chat.BUDGET) or (w.n_new == 1 and w.n_repeated == 0)


def brute_windows(said, budget, history, span):
    """(n_repeated, n_new, tokens, formatted) of each window of a conversation [(role, text)], by the rules as stated."""
    tok = [len(t.split()) + 1 for _, t in said]
    start = [sum(tok[:k]) for k in range(len(said))]
    first = next((k for k, (r, _) in enumerate(said) if r == "system"), None)
    held = first if first is not None and 2 * tok[first] <= budget else None
    room, out, at = max(1, budget - history - (tok[held] if held is not None else 0)), [], 0
    while at < len(said):
        end = at + 1
        while end < len(said) and start[end] // span == start[at] // span and start[end] + tok[end] - start[at] <= room:
            end += 1
        left = budget - sum(tok[at:end])
        lead = [held] if held is not None and not at <= held < end and tok[held] <= left else []
        back, most = at, min(history, left - sum(tok[k] for k in lead))
        while back and start[at] - start[back - 1] <= most:
            back -= 1
        repeated = lead + [k for k in range(back, at) if k not in lead]
        shown = repeated + list(range(at, end))
        out.append((len(repeated), end - at, sum(tok[k] for k in shown), "".join(f"<|turn|>{said[k][0]}\n{said[k][1]}<|end|>\n" for k in shown)))
        at = end
    return out


@pytest.mark.parametrize("number", [lambda t: t, lambda t: 1000 * t, lambda t: None if t < 250 else t, lambda t: 5], ids=["steps", "gaps", "nulls", "equal"])
@pytest.mark.parametrize(("count", "words", "system", "budget", "history"), [(300, 4, 9, 400, 200), (300, 0, 0, 400, 200), (300, 9, 150, 256, 64), (120, 3, 0, 4000, 256), (60, 700, 30, 2048, 256), (10_000, 6, 20, 2048, 256)])
def test_chat_windows(spark, monkeypatch, number, count, words, system, budget, history):
    """Windows, history and the budget against brute force: long and short turns, any numbering, spans that end within the conversation."""
    monkeypatch.setattr(chat, "SPAN", 5000)
    rng = np.random.default_rng(count + words)
    said = [(number(t), ("user", "assistant")[t % 2], " ".join([f"w{t:05d}", *["x"] * int(rng.integers(0, 2 * words + 1))])) for t in range(count)]
    if system:
        said.append((number(7), "system", "s " * system))
    if words > 100:
        said.append((number(20), "user", "y " * 3000))
    table = spark.createDataFrame([(7, *x) for x in said], "conv_id long, turn long, role string, text string").repartition(6)
    found = [(w.n_repeated, w.n_new, w.tokens, w.formatted) for w in chat.chat_windows(table, budget, history).orderBy("span", "window").collect()]
    order = sorted(said, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    want = brute_windows([x[1:] for x in order], budget, history, 5000)
    assert found == want and all(t <= budget or (n == 1 and not r) for r, n, t, _ in found)


def test_chat_empty(spark):
    assert chat.chat_digests(chat.chat_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def plain_rows(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


@pytest.mark.parametrize("make", [documents, odd])
def test_pipeline_stages(spark, make):
    """Each stage against plain Python on what the one before kept."""
    docs, names = make(spark).select(*corpus_pipeline.COLUMNS), [n for n, _ in corpus_pipeline.STAGES]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(durable(stage(spark, kept[-1], SMALL), "stage"))
    rows = [plain_rows(k) if k.columns == list(corpus_pipeline.COLUMNS) else k.collect() for k in kept]
    seen = language_id.identify(docs, F.lit(True), keep=("text", "lang")).collect()
    stays = [r for r in seen if any(ch.isalpha() for ch in r.text or "") and (r.score >= corpus_pipeline.FLOOR or r.lang == r.lang_pred)]
    assert names[1] == "exact dedup" and Counter(rows[1]) == Counter((r.doc_id, r.text or "") for r in stays)
    assert Counter((r.doc_id, r.lang) for r in kept[1].collect()) == Counter((r.doc_id, r.lang or r.lang_pred) for r in stays)
    best = {}
    for i, t in rows[1]:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    assert Counter(t for _, t in rows[2]) == Counter(best.keys())
    assert len(set(rows[3])) == len(rows[3]) and Counter(rows[3]) == near_brute(rows[2])
    assert set(rows[4]) <= set(rows[3]) and max(Counter(rows[4]).values()) <= 3
    assert Counter(r.doc_id for r in rows[5] if r.piece == 0) == Counter(i for i, _ in rows[4])


def near_brute(rows):
    from .test_documents import sets

    own, root = [sets(t, 5) for _, t in rows], list(range(len(rows)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(own)):
        for b in range(a):
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                root[top(a)] = top(b)
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        name = (i is not None, i or 0, hashlib.sha256(t.encode()).hexdigest())
        groups[top(k) if own[k] else name].append((name, (i, t)))
    return Counter(min(g)[1] for g in groups.values())


def test_pipeline_near_copies_alone(spark):
    """Equal texts of different or equal ids, as that stage sees them when exact dedup hasn't run: one of each group stays."""
    docs = odd(spark).unionByName(odd(spark)).select(*corpus_pipeline.COLUMNS)
    assert Counter(plain_rows(corpus_pipeline.near_copies(spark, docs, SMALL))) == near_brute(plain_rows(docs))


def test_pipeline_languages(spark):
    """Without labels, documents with a letter stay; with them, one that the classifier finds no language in goes unless its label is the best guess."""
    docs = odd(spark).select(*corpus_pipeline.COLUMNS)
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert Counter(plain_rows(corpus_pipeline.language_id(spark, bare, SMALL))) == Counter(r for r in plain_rows(docs) if any(ch.isalpha() for ch in r[1]))
    alien = spark.createDataFrame([(-1, "ΞΨΩ ϠϡϢ", None, "a", None)], bare.schema)
    got = plain_rows(corpus_pipeline.language_id(spark, documents(spark).select(*corpus_pipeline.COLUMNS).unionByName(alien), SMALL))
    assert (-1, "ΞΨΩ ϠϡϢ") not in got and len(got) > 100


def test_pipeline_stages_on_an_empty_table(spark):
    none = empty(spark).select(*corpus_pipeline.COLUMNS)
    assert [stage(spark, none, SMALL).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
