"""Operators on documents against brute force, on the smallest table and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomtext.llm import language_id, lexicon, mixing, ngram_join, packing, pii, ppm, token_counts
from loomtext.llm.components import components
from loomtext.llm.exact_dedup import exact_dedup, survivors
from loomtext.llm.queries import remainder

from .data import documents, empty, odd

TABLES = [documents, odd]


def text(t):
    return t or ""


def spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@pytest.mark.parametrize("make", TABLES)
def test_pii(spark, make):
    docs = make(spark)
    want = Counter((r.doc_id, ",".join(f"{k}:{s}:{e}" for k, s, e in spans(text(r.text)))) for r in docs.collect())
    found = pii.find_pii(docs).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in found) == Counter({(i, hashlib.sha256(s.encode()).hexdigest()): n for (i, s), n in want.items()})
    assert all(len(r.spans.split(",")) >= r.n_email + r.n_ip + r.n_card + r.n_phone for r in found if r.spans)


def test_pii_shapes_fuzz():
    rng, al = np.random.default_rng(3), "a1.@-+ ()0 5b.%:2[at]"
    for _ in range(3000):
        t = "".join(rng.choice(list(al), rng.integers(0, 60)))
        assert [(pii.KINDS[k], s, e) for k, s, e, base, _ in pii.shapes(t) if base] == spans(t)


def test_pii_learns(spark):
    """Loose shapes are added where the labelers agree; a number that the words before speak against isn't."""
    rows = [(i, f"call phone +1 (212) 555-{1000 + i} now") for i in range(40)] + [(100 + i, f"order ref {i} serial +{i}23-4") for i in range(20)]
    rows += [(200, "please call (212) 555-0199 today"), (201, "write to bob [at] mail [dot] com soon")]
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[200].spans == "phone:12:26" and found[200].n_phone == 0 and found[201].spans.startswith("email:9:")


#: (text before, the span, its kind or None where it isn't personal data, text after)
LINES = [
    ("mail bob", " [at] mail [dot] com", "email", " or"), ("write to ann.lee", "(at)example(dot)org", "email", " now"), ("reach x", " at mail dot net", "email", ", he said"),
    ("host ", "2001:db8::8a2e:370:7334", "ip", " is up"), ("address ", "fe80:0:0:0:202:b3ff:fe1e:8329", "ip", "."), ("server ", "10[.]1[.]22[.]3", "ip", " down"),
    ("card ", "4539.1488.0343.6467", "card", " paid"), ("visa ", "4539/1488/0343/6467", "card", "."),
    ("call ", "(212) 555-0199", "phone", " today"), ("phone ", "0044 20 7946 0958", "phone", "."),
    ('api_key = "', "9f8a7c6b5d4e3f2a1b0c9d8e7f6a5b4c", "secret", '" # do not share'), ("password: '", "hV7x!pQ2mZ9k", "secret", "' set"), ("use ", "ghp_16C7e42F292c6912E7710c838347Ae178B4a", "secret", " to push"),
    ("order ref ", "299 555-0199 4", None, " sent"), ("commit = '", "shortname-only", None, "' done"), ("std", "::dec", None, " and a::b"), ("he was at dot ", "com", None, "s"),
    ("chapter ", "1234.5678.9012.3456", None, " of"), ("the ", "internationalizationally2", None, " word"), ("at 10:20:30 ", "1:2", None, " won"),
]


def test_pii_added_spans(spark):
    """Precision and recall of what the method adds, on labelled lines among ordinary ones that the labelers learn from."""
    rows = [(k, b + s + a) for k, (b, s, _, a) in enumerate(LINES)]
    rows += [(100 + k, f'token = "{hashlib.sha1(str(k).encode()).hexdigest()}" and mail a{k}@b.com, host 10.0.{k % 256}.7, phone +1 (212) 555-{1000 + k}') for k in range(60)]
    rows += [(300 + k, f"order ref {k} serial +{k}23-4, version 300.1.2.{k}, id {4539148803436000 + 10 * k}") for k in range(60)]
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = want = got = 0
    for k, (b, s, kind, _) in enumerate(LINES):
        spans = [x.split(":") for x in found[k].spans.split(",") if x]
        start = len(b) - len(b.rsplit(" ", 1)[-1]) if kind == "email" else len(b)
        want, got = want + (kind is not None), got + len(spans)
        hit += [kind, str(start), str(len(b) + len(s))] in spans
    assert hit / want >= 0.9 and hit / got >= 0.9, [(k, found[k].spans, LINES[k]) for k in range(len(LINES))]
    assert all(found[100 + k].spans.endswith("secret:9:49") and found[100 + k].n_spans == 4 for k in range(60)) and not any(found[300 + k].n_added for k in range(60))


def test_pii_long_spans_and_texts():
    """Spans aren't clipped, and many of them take time in proportion."""
    assert [x[:3] for x in pii.shapes("x" * 500 + " [at] mail [dot] com")] == [(0, 0, 520)]
    import time

    def took(n):
        began = time.process_time()
        assert len(pii.shapes("call (212) 555-0199 or +1 (212) 555-0123 a b::c 1.2.3.4 " * n)) == 4 * n
        return time.process_time() - began

    took(100)
    assert took(16_000) < 12 * took(4_000) + 0.5


def test_reliabilities_are_recovered():
    """EM over votes drawn from known tables finds these tables."""
    rng = np.random.default_rng(11)
    true = np.array([[[0.7, 0.2, 0.1], [0.05, 0.15, 0.8]], [[0.6, 0.1, 0.3], [0.1, 0.1, 0.8]], [[0.3, 0.6, 0.1], [0.1, 0.4, 0.5]], [[0.2, 0.75, 0.05], [0.05, 0.55, 0.4]], [[0.5, 0.0, 0.5], [0.1, 0.0, 0.9]]])
    kind = rng.integers(0, len(pii.KINDS), 60_000)
    y = rng.random(len(kind)) < np.array([0.5, 0.3, 0.6, 0.4, 0.5])[kind]
    v = np.stack([(rng.random(len(kind))[:, None] > np.cumsum(true[j][y.astype(int)], 1)).sum(1) for j in range(5)], 1)
    pattern, n = np.unique(np.column_stack([kind, v]), axis=0, return_counts=True)
    p, table, prior = pii.reliabilities(pattern[:, 0], pattern[:, 1:], n.astype(float), rounds=300)
    assert np.abs(table - true).max() < 0.06 and np.abs(prior - [0.5, 0.3, 0.6, 0.4, 0.5]).max() < 0.06
    x = pii.features(pattern[:, 0], pattern[:, 1:], np.zeros((len(pattern), 4)))
    q = 1 / (1 + np.exp(-x @ pii.train(x, p, n.astype(float))))
    by = {tuple(r): k for k, r in enumerate(pattern)}
    at = [by[tuple(r)] for r in np.column_stack([kind, v])]
    assert np.mean((q[at] >= 0.5) == y) > 0.85


def sets(t, w):
    x = text(t).encode().lower().split()
    return {tuple(x[k : k + w]) for k in range(len(x) - w + 1)} if len(x) >= w else {tuple(x)} if x else set()


@pytest.mark.parametrize("make", TABLES)
@pytest.mark.parametrize(("words", "num"), [(4, 85), (5, 80)])
def test_ngram_join(spark, make, words, num):
    rows = make(spark).collect()
    own, root = [sets(r.text, words) for r in rows], list(range(len(rows)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= num * len(own[a] | own[b]):
                root[top(a)] = top(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[top(k)] += [r.doc_id] if r.doc_id is not None else []
    want = Counter((r.doc_id, len(own[k]), min(least[top(k)], default=None)) for k, r in enumerate(rows))
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(make(spark), words, num, 100).collect()) == want


def test_ngram_join_in_blocks(spark, monkeypatch):
    """Groups and components above their limits are split without losing a link."""
    for name in ("GROUP", "SMALL"):
        monkeypatch.setattr(ngram_join, name, 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 200)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[: i % 7], "x", *base[i % 7 + 1 :]])) for i in range(30)] + [(99, "nothing like it at all here")]
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict.fromkeys(range(30), 0) | {99: 99}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_in_rounds(spark, monkeypatch, seed):
    """Families that share passages, chains of links that run through them, and loners, in blocks far smaller than the groups."""
    for name, n in (("GROUP", 4), ("SMALL", 3), ("BLOCK", 150)):
        monkeypatch.setattr(ngram_join, name, n)
    rng = np.random.default_rng(seed)
    common, rows = [f"c{k}" for k in range(25)], []
    for family in range(4):
        base = common + [f"f{family}w{k}" for k in range(30)]
        for _ in range(25):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 4)):
                words[at] = f"x{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(words[: len(words) - rng.integers(0, 4)])))
    own, root = [sets(t, 5) for _, t in rows], list(range(len(rows)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: top(k) for k in range(len(rows))} and 4 < len(set(found.values())) < 100


@pytest.mark.parametrize("make", [*TABLES, "family"])
@pytest.mark.parametrize("block", [ngram_join.BLOCK, 200])
def test_ngram_join_links(spark, monkeypatch, make, block):
    """Every link counts, those between two members that a third has joined already too; in blocks, each once."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = [f"w{k}" for k in range(60)]
    family = [(i, " ".join([*base[: i % 17], "x", *base[i % 17 + 1 :]])) for i in range(40)] + [(99, "nothing like it at all here")]
    docs = spark.createDataFrame(family, "doc_id long, text string") if make == "family" else make(spark)
    rows = docs.collect()
    own = [sets(r.text, 5) for r in rows]
    links = [sum(a != b and 100 * len(x & y) >= 80 * len(x | y) for b, y in enumerate(own) if y) if x else 0 for a, x in enumerate(own)]
    found = ngram_join.near_duplicates(docs, links=True)
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in found.collect()) == Counter((r.doc_id, len(x), n) for r, x, n in zip(rows, own, links, strict=True))
    assert Counter(map(tuple, found.drop("n_links").collect())) == Counter(map(tuple, ngram_join.near_duplicates(docs).collect()))


def test_count_tree_bounds():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 6, (700, ngram_join.GROUPS)).astype(np.int32)
    v[1::2] = v[::2] + rng.integers(0, 2, (350, 1)) * np.eye(ngram_join.GROUPS, dtype=np.int32)[rng.integers(0, ngram_join.GROUPS, 350)]
    n = v.sum(1).astype(np.int64)
    tree, alive = ngram_join.CountTree(n, v, 80, 100), np.ones(700, bool)
    for q in range(0, 700, 37):
        want = np.flatnonzero(np.minimum(v, v[q]).sum(1) >= ngram_join.need(n, n[q], 80, 100))
        assert sorted(tree.candidates(q, alive)) == want.tolist()


def test_without(spark):
    docs = odd(spark)
    dropped = spark.createDataFrame([("one",), ("nowhere",)], "key string")
    assert ngram_join.without(docs, dropped, F.coalesce("text", F.lit(""))).count() == docs.count() - 1


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7), (102, 100)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert all(found[k] == 0 for k in range(1, 41)) and found[101] == found[102] == 100


@pytest.mark.parametrize("make", TABLES)
def test_language(spark, make):
    docs = make(spark)
    found = language_id.identify(docs, remainder(4) != 2 if make is documents else F.lit(True), keep=("lang",)).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    no_letter = docs.where(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).count()
    assert sum(r.lang_pred == "und" for r in found) == no_letter
    if make is documents:
        assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95


def test_language_sample(spark, monkeypatch):
    """Equal shares of distinct texts of each language, with bounded lengths, whatever is repeated how often."""
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 50)
    rows = [(k, f"some words of text number {k} " * 9, "en") for k in range(900)] + [(None, "the same text", "en")] * 500 + [(k, f"ein paar deutsche {k}", "de") for k in range(40)]
    found = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), "doc_id", "text", "lang", 200)
    assert Counter(x for _, x in found) == {"en": 100, "de": 40} and len(set(found)) == 140 and max(len(t) for t, _ in found) == 50


def test_language_features_are_bounded(monkeypatch):
    monkeypatch.setattr(language_id, "GRAMS", 40)
    c = language_id.Classifier([f"the cat {k} and the dog" for k in range(30)] + [f"der hund {k} und die katze" for k in range(30)], ["en"] * 30 + ["de"] * 30)
    assert len(c.spectrum.keys) == 40 and [x for x, _ in c.predict(["the dog and the cat", "die katze und der hund"])] == ["en", "de"]


def test_spectrum_presence():
    texts = ["abcabd", "xyz", "Äbc de"]
    s = language_id.Spectrum(np.unique(np.concatenate([language_id.ngrams(t) for t in texts])))
    for t in [*texts, "abd xyz", ""]:
        row = np.zeros(len(s.keys), np.float32)
        s.presence(t, row)
        assert row.tolist() == np.isin(s.keys, language_id.ngrams(t)).astype(float).tolist()


@pytest.mark.parametrize("make", TABLES)
@pytest.mark.parametrize("common", [50, lexicon.LIMIT])
def test_token_counts(spark, make, common):
    path = public_tokenizers.path("piece_bpe_32k.model")
    m = token_counts.model(path)
    want = Counter((r.doc_id, len(text(r.text).encode()), len(m.encode(text(r.text))), len(m.encode(text(r.text))) > 500) for r in make(spark).collect())
    assert Counter(tuple(r) for r in token_counts.token_counts(make(spark), path, 500, common_limit=common).collect()) == want


def test_pre_tokens_fuzz():
    m, rng, al = token_counts.model(public_tokenizers.path("piece_bpe_32k.model")), np.random.default_rng(5), list("ab \n\t▁é.\r<s>/日́\xa0 ")
    for _ in range(3000):
        t = "".join(rng.choice(al, rng.integers(0, 20)))
        assert sum(token_counts.pieces(m, token_counts.pre_tokens(t))) == len(m.encode(t))


@pytest.mark.parametrize("make", TABLES)
def test_packing(spark, make):
    from tokenizers import Tokenizer

    path, capacity = public_tokenizers.path("byte_bpe_50k.json"), 512
    library = Tokenizer.from_file(path)
    want = Counter()
    for r in make(spark).collect():
        ids = np.array([*library.encode(text(r.text), add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want.update((r.doc_id, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)))
    found = packing.pack(make(spark), path, capacity).collect()
    assert Counter(tuple(r)[:5] for r in found) == want
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= capacity and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for x in by.values())
    assert len(by) <= math.ceil(sum(r.length for r in found) / capacity) * 1.02 + 1


def triplets(seed, n=200):
    """Lengths of which three each fill a bin of 1000, so 3 n pieces fit in n bins, which best fit doesn't find."""
    rng = np.random.default_rng(seed)
    a = rng.integers(380, 490, n)
    b = rng.integers(250, 1000 - a - 250 + 1)
    return rng.permutation(np.concatenate([a, b, 1000 - a - b]))


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(2)
    x = triplets(1)
    a, (b, made) = packing.best_fit(x, 1000), packing.evolve(x, 1000, 1)
    for owner in (a, b, packing.crossover(a, b, x, 1000, rng), packing.varied(a, x, 1000, rng), packing.evolve(x, 1000, 3, a, [[int(x[0]), int(x[1])], [999, 1]])[0]):
        assert (owner >= 0).all() and np.bincount(owner, weights=x).max() <= 1000 and (np.bincount(owner) > 0).all()
    assert made == packing.GENERATIONS


@pytest.mark.parametrize("seed", range(5))
def test_genetic_algorithm_beats_best_fit(seed):
    x = triplets(seed)
    owner, made = packing.evolve(x, 1000, seed)
    assert packing.least_bins(x, 1000) <= owner.max() + 1 < packing.best_fit(x, 1000).max() + 1 and made > 0
    assert packing.evolve(np.full(100, 250), 1000, seed)[1] == 0  # best fit is at the bound: nothing to do


def test_islands_migrate(spark, monkeypatch):
    """All pieces stay, elite bins arrive, and no epoch makes it worse."""
    monkeypatch.setattr(packing, "ISLAND", 150)
    pieces = spark.createDataFrame([(k, int(n)) for k, n in enumerate(triplets(7))], "uid long, length int")
    bins = lambda rows: len({(r.island, r.bin) for r in rows})
    found = packing.islands(pieces, 1000, 1).collect()
    monkeypatch.setattr(packing, "EPOCHS", 1)
    first = packing.islands(pieces, 1000, 1).collect()
    assert sorted(r.uid for r in found) == list(range(600)) and bins(found) <= bins(first) and len({r.island for r in found}) > 1
    groups = packing.rebuilt([[300, 200], [300, 999], [200, 100]], np.array([100, 200, 200, 300]))
    assert groups.tolist() == [2, 2, 0, 0]


def test_ids_fuzz():
    e, rng = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), np.random.default_rng(6)
    kinds = [list(" \n\t\r'stremlvd' a1é.\xa0\x85\x1c<|"), [chr(c) for c in range(0x250)], list("aé 日\u2003\u3000ﬁ\U0001f600'sǆ٣")]
    texts = ["".join(rng.choice(kinds[k % 3], rng.integers(0, 40))) for k in range(6000)]
    assert e.whole and [e.ids(t) for t in texts] == [np.array(x.ids, "<u4").tobytes() for x in e.library.encode_batch(texts, add_special_tokens=False)]
    assert packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).whole is None


@pytest.mark.parametrize("make", TABLES)
def test_mixing(spark, make):
    rows = make(spark).collect()
    found = mixing.mix(make(spark), keep=("source",)).collect()
    sizes = [(r.source, len(text(r.text).encode().split())) for r in rows]
    assert Counter((r.source, r["size"]) for r in found) == Counter(sizes)
    by = Counter()
    for s, n in sizes:
        by[s] += n
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight, left, goal = {s: k % 3 + 1 for k, s in enumerate(names)}, float(sum(by.values())), {}
    free = list(names)
    while True:
        level = left / max(1, sum(weight[s] for s in free)) if free else 0
        over = [s for s in free if level * weight[s] > 3 * by[s] + 1e-9]
        if not over:
            break
        for s in over:
            goal[s] = 3.0 * by[s]
            left -= goal[s]
            free.remove(s)
    goal |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in found:
        assert r.source_size == by[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    most = {s: max(n for t, n in sizes if t == s) for s in by}
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in by)
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.mix(make(spark).repartition(5), keep=("source",)).collect()))


@pytest.mark.parametrize("make", TABLES)
@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 1)], ids=["sha256", "colliding"])
def test_exact_dedup(spark, make, digest):
    rows = make(spark).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[text(r.text)].append(r.doc_id)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    found = exact_dedup(make(spark), digest=digest).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter(tuple(r)[:3] + (r.text_sha256,) for r in found) == Counter((r.doc_id, best[text(r.text)], len(groups[text(r.text)]), sha(text(r.text))) for r in rows)
    assert Counter((r.doc_id, r.text_sha256) for r in found if r.kept) == Counter((best[t], sha(t)) for t in groups)
    assert Counter((r.doc_id, text(r.text)) for r in survivors(make(spark)).collect()) == Counter((best[t], t) for t in groups)


def brute_ppm(train):
    count, order = defaultdict(Counter), ppm.ORDER
    seq = lambda t: [-1] * order + list(b" ".join(text(t).encode().lower().split())) + [256]
    for t in train:
        s = seq(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                count[tuple(s[i - k : i])][s[i]] += 1

    def log(t):
        s, out = seq(t), 0.0
        for i in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                if not (c := count.get(tuple(s[i - k : i]))):
                    continue
                rest = {a: n for a, n in c.items() if a not in gone}
                n, d = sum(rest.values()), len(rest)
                if s[i] in rest:
                    out += math.log10((2 * rest[s[i]] - 1) / (2 * n))
                    break
                out += math.log10(d / (2 * n)) if d else 0
                gone = set(c)
            else:
                out -= math.log10(257 - len(count[()]))
        return out

    return log


@pytest.mark.parametrize("make", TABLES)
@pytest.mark.parametrize("small", [False, True])
def test_lm(spark, monkeypatch, make, small):
    if small:
        monkeypatch.setattr(ppm, "STRETCH", 500)
    rows = make(spark).collect()
    learnt = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 != 0
    train = [text(r.text) for r in rows if learnt(r.doc_id)]
    c = Counter(w for t in train for w in t.encode().lower().split())
    total, below = sum(c.values()) + len(train), sum(c.values()) + len(train) + 0.1 * (len(c) + 2)
    log, base = brute_ppm(train), lambda n: math.log10((n + 0.1) / below)
    limits = {"common_words": 20, "common_grams": 100} if small else {}
    found = {(r.doc_id, r.n_tokens): r for r in ppm.score(make(spark), remainder(10) != 0, **limits).collect()}
    for r in rows[:: 9 if make is documents else 1]:
        w = text(r.text).encode().lower().split()
        f = found[r.doc_id, len(w) + 1]
        assert f.held_out != learnt(r.doc_id) and f.train_tokens == total and f.n_known == sum(x in c for x in w) + 1
        assert math.isclose(f.base_score, sum(base(c[x]) for x in w) + base(len(train)), rel_tol=1e-9) and math.isclose(f.score, log(r.text), rel_tol=1e-5, abs_tol=1e-4)


def test_lm_table():
    """Every key and no other; 24 bytes a key at most, where half of an open table is empty."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 3000, 200_000):
        keys = rng.permutation(np.unique(rng.integers(0, 1 << 54, n)))
        others = np.setdiff1d(rng.integers(0, 1 << 54, 5000), keys)
        t = ppm.Table(keys, -1.0 - np.arange(len(keys)))
        value, lost = t.get(np.concatenate([keys, others]))
        assert (value[: len(keys)] == -1.0 - np.arange(len(keys))).all() and not value[len(keys) :].any()
        assert not lost[: len(keys)].any() and lost[len(keys) :].all()
        assert sum(x.nbytes for x in vars(t).values() if isinstance(x, np.ndarray)) <= 24 * n + 200


def test_lm_counts_in_small_batches(monkeypatch):
    """Counts are given out in pieces, none twice and none lost."""
    texts = [f"{i} some words {i * i}" for i in range(300)] + [None, ""]
    batch = ppm.pa.RecordBatch.from_arrays([ppm.pa.array(texts), ppm.pa.array([i % 3 > 0 for i in range(len(texts))])], names=["text", "train"])
    whole = list(ppm.count_grams([batch]))
    monkeypatch.setattr(ppm, "ROWS", 50)
    monkeypatch.setattr(ppm, "CHUNK", 100)
    parts = list(ppm.count_grams([batch]))
    assert max(map(len, parts)) == 50 and ppm.pa.Table.from_batches(parts).equals(ppm.pa.Table.from_batches(whole).combine_chunks())


def test_lm_sums_to_one():
    """Over all symbols that can follow a context, seen or not."""
    texts = [b"abracadabra", b"abc abc", b"banana"]
    g, n = np.unique(ppm.grams(ppm.symbols(texts)), return_counts=True)
    top = ppm.Top(*ppm.merged(g & (1 << 27) - 1, n))
    for context in np.unique(g >> 9)[:10]:
        keys = (context << 9) + np.arange(1, ppm.SYMBOLS)
        every = np.unique(np.concatenate([g, keys]))
        counts = np.zeros(len(every), np.int64)
        counts[np.searchsorted(every, g)] = n
        p = 10 ** ppm.log_probabilities(every, counts, top)
        assert abs(p[np.searchsorted(every, keys)].sum() - 1) < 1e-9


def test_empty_tables(spark):
    none = empty(spark)
    path = public_tokenizers.path
    results = [
        pii.find_pii(none), ngram_join.near_duplicates(none), language_id.identify(none, F.lit(True)), token_counts.token_counts(none, path("piece_bpe_32k.model")),
        packing.pack(none, path("byte_bpe_50k.json")), mixing.mix(none), exact_dedup(none), survivors(none), ppm.score(none, F.lit(True)),
    ]
    assert [r.count() for r in results] == [0] * len(results)
