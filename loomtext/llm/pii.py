"""Personal data by weak supervision.

1. One pass over the texts finds the base spans (fixed patterns) and candidates of looser shape: e-mails with spelled-out signs, IPv6
   and defanged addresses, cards with other separators, phone numbers without +, and a kind without base spans, secrets (quoted
   values given to a name, and long runs of mixed letters and digits). Five labelers vote yes, no or nothing on
   each: the regex shape, the check rule of the kind, a gazetteer, the words before it, its borders.
2. Equal vote patterns are counted; expectation-maximisation over these counts estimates how reliable each labeler is and how
   likely each pattern is personal data. Their number is bounded (5 kinds x 3^5 votes x 16 shapes), whatever the corpus holds.
3. A logistic regression trained on these soft labels is the final span classifier; candidates at THRESHOLD or more are added.
   Base spans always stay, and no added span overlaps one, or another added one of its kind. Base matches that fail their check are learnt from, never added.

Defined cases: a null text is empty; offsets are code points, end exclusive; repeated rows give equal rows; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from ipaddress import AddressValueError, IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds with base spans.
BASE = KINDS[:4]
LABELERS = ("regex", "check", "gazetteer", "context", "border")
THRESHOLD = 0.5

# The possessive forms match what the plain ones do, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Looser shapes
AT = re.compile(r"\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20(?=[A-Za-z0-9-]+\x20?[\[(]?\x20?dot\b)", re.I)
DOTTED = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]+)+", re.I)
IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:])")
DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:[\[(]\.[\])]|[\[(]dot[\])])\x20?[0-9]{1,3}){3}(?![0-9.])", re.I)
PARTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}(?:[. /][0-9]{4}){3}(?![0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9])")
LONG_PHONE = re.compile(r"(?<![\w+.])00[1-9](?:[\x20().-]{0,2}[0-9]){7,13}(?![\w-])")
GIVEN = re.compile(r"(?<!\w)([A-Za-z][A-Za-z0-9_.-]{0,40})[\"']?\x20?[:=]\x20?[\"']([^\s\"']{8,200})[\"']")
MIXED = re.compile(r"(?<![\w/+=.-])[A-Za-z0-9_/+-]{20,}={0,2}(?![\w/+=-])")
HEX = re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})\Z")
LETTERS = re.compile(r"[A-Za-z]+")

# Gazetteers: fixed values
ENDINGS = frozenset("com org net edu gov io de fr es it uk eu info biz us ca ch at nl be".split())
ISSUERS = ("4", "34", "35", "36", "37", "38", "51", "52", "53", "54", "55", "60", "62", "64", "65")
CUES = {
    "email": frozenset("email mail contact write reach address courriel correo kontakt".split()),
    "ip": frozenset("ip host server address from client login".split()),
    "card": frozenset("card visa credit debit mastercard amex payment karte tarjeta carte".split()),
    "phone": frozenset("call phone tel telephone mobile cell fax contact telefon llame appelez".split()),
    "secret": frozenset("token secret password passwd pwd key apikey credential credentials bearer auth login private".split()),
}
SECRET_NAMES = frozenset("token secret password passwd pwd apikey api_key access_key secret_key access_token auth_token private_key client_secret credential bearer key".split())
PLAIN_NAMES = frozenset("id name title class href src sha commit checksum digest etag hash md5 sha1 sha256 version uuid color font".split())
ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ")
AGAINST = frozenset("order version isbn invoice ref release chapter section page part serial id build".split())

SPAN = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("base", T.BooleanType())])


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost non-overlapping matches of the e-mail pattern, found from each @."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def spelled_emails(text: str):
    """E-mail addresses with a spelled-out at sign; what stands before it is taken whole."""
    end = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        after = DOTTED.match(text, m.end())
        if start < m.start() and after and start >= end:
            yield start, after.end()
            end = after.end()


def is_ip6(s: str) -> bool:
    try:
        return bool(IPv6Address(s)) and len(s) > 3
    except AddressValueError:
        return False


def secrets(text: str):
    """(start, end): values given to a name, and long runs that mix letters and digits."""
    for m in GIVEN.finditer(text) if '"' in text or "'" in text else ():
        yield m.start(2), m.end(2)
    for m in MIXED.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            yield m.start(), m.end()


def loose(text: str):
    """(kind, start, end, usable) of what isn't base."""
    for s, e in spelled_emails(text):
        yield 0, s, e, True
    if "::" in text or text.count(":") >= 7:
        for m in IP6.finditer(text):
            if is_ip6(m[0]):
                yield 1, m.start(), m.end(), True
    if "[" in text or "(" in text:
        for m in DEFANGED.finditer(text):
            yield 1, m.start(), m.end(), all(int(x) <= 255 for x in re.findall("[0-9]+", m[0]))
    for m in PARTED_CARD.finditer(text):
        yield 2, m.start(), m.end(), True
    for p in (LOCAL_PHONE, LONG_PHONE):
        for m in p.finditer(text):
            yield 3, m.start(), m.end(), True
    for s, e in secrets(text):
        yield 4, s, e, True


def shapes(text: str) -> list[tuple[int, int, int, bool, bool]]:
    """(kind, start, end, base, usable): base spans, looser candidates, and base matches that fail their check (to learn from only)."""
    out = [(0, s, e, True, True) for s, e in emails(text)]
    for m in IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))
        out.append((1, m.start(), m.end(), ok, ok))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            n = len(d := digits_of(m[0]))
            if 16 <= n <= 19:
                ok = luhn(d)
                out.append((2, m.start(), m.end(), ok, ok))
            elif 13 <= n <= 15 and luhn(d):
                out.append((2, m.start(), m.end(), False, True))
    for m in PHONE.finditer(text):
        ok = 8 <= len(digits_of(m[0])) <= 15
        out.append((3, m.start(), m.end(), ok, ok))
    out += [(k, s, e, False, ok) for k, s, e, ok in loose(text)]
    out.sort(key=lambda x: (x[0], x[1], not x[3], -x[2]))
    # what isn't base must not overlap a base span nor, within its kind, what stands before it
    base = sorted((s, e) for _, s, e, b, _ in out if b)
    starts, reach = [s for s, _ in base], list(itertools.accumulate((e for _, e in base), max))
    kept, last = [], {}
    for x in out:
        k, s, e, b, usable = x
        at = bisect.bisect_left(starts, e)
        if not b and ((usable and s < last.get(k, 0)) or (at and reach[at - 1] > s)):
            continue
        if usable and e > last.get(k, -1):  # a failed base match doesn't hide what is in it
            last[k] = e
        kept.append(x)
    return kept


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in map(s.count, set(s)))


def votes(text: str, k: int, s: int, e: int, base: bool, usable: bool) -> int:
    """Pattern code: kind, the five votes (0 no, 1 nothing, 2 yes) and the shape bits."""
    span, kind = text[s:e], KINDS[k]
    d = digits_of(span)
    regex = 2 if base else 1 if usable else 0
    if kind == "card":
        check = 2 if luhn(d) and len(set(d)) > 1 else 0
        gazetteer = 2 if d.startswith(ISSUERS) else 0
    elif kind == "phone":
        check = 2 if 8 <= len(d) <= 15 else 0
        area = d[-10:-7] if len(d) >= 10 else ""
        gazetteer = 1 if not area else 2 if area[0] not in "01" else 0
    elif kind == "ip":
        check = 2 if usable and d and (":" not in span or len(re.findall("[0-9A-Fa-f]+", span)) > 2) else 0
        gazetteer = 0 if span.startswith(("0.", "00")) else 2
    elif kind == "email":
        check = 2 if "." in span or "dot" in span.lower() else 0
        ending = LETTERS.findall(span)[-1:] or [""]
        gazetteer = 2 if ending[0].lower() in ENDINGS else 1
    else:
        regex = 2 if HEX.match(span) or span.startswith(ISSUED) else 1 if d else 0
        check = 2 if len(span) <= 8 * len(d) < 8 * len(span) and entropy(span[:200]) >= 3 else 0
        name = re.search(r"([A-Za-z][A-Za-z0-9_.-]{0,40})[\"']?\x20?[:=]\x20?[\"']?\Z", text[max(0, s - 50) : s])
        name = name[1].lower().replace("-", "_") if name else ""
        gazetteer = 1 if not name else 2 if name in SECRET_NAMES or name.rpartition("_")[2] in SECRET_NAMES else 0 if name in PLAIN_NAMES else 1
    words = {w.lower() for w in LETTERS.findall(text[max(0, s - 40) : s])[-4:]}
    context = 0 if words & AGAINST else 2 if words & CUES[kind] else 1
    border = 0 if (s > 0 and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()) else 2
    code = k
    for v in (regex, check, gazetteer, context, border):
        code = code * 3 + v
    shape = (len(span) > 16) | (" " in span) << 1 | ("(" in span or "[" in span) << 2 | usable << 3
    return code * 16 + shape


def extract(batches):
    """(doc_id, text) -> base counts and digest, and all spans with their votes."""
    for batch in batches:
        counts, shas, spans = [[] for _ in BASE], [], []
        for text in batch.column(1).to_pylist():
            found = shapes(text) if text else []
            base = [x for x in found if x[3]]
            for k in range(len(BASE)):
                counts[k].append(sum(x[0] == k for x in base))
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in base).encode()).hexdigest())
            spans.append([{"k": k, "s": s, "e": e, "code": votes(text, k, s, e, b, u), "base": b} for k, s, e, b, u in found])
        kind = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("code", pa.int32()), ("base", pa.bool_())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, kind)],
            names=["id", *(f"n_{k}" for k in BASE), "base_sha256", "found"],
        )


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kind, votes (n x 5), shape bits (n x 4)."""
    shape, rest = codes % 16, codes // 16
    v = np.stack([rest // 3 ** (4 - j) % 3 for j in range(5)], 1)
    return rest // 3**5, v, np.stack([shape >> j & 1 for j in range(4)], 1)


def reliabilities(kind: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over counted vote patterns: P(personal) of each pattern, P(vote | class) of each labeler, prior of each kind.

    It starts from the majority of the votes, and the labelers' tables start as better than chance, so classes can't swap.
    """
    p = 1 / (1 + np.exp(-(v - 1).sum(1)))
    like = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])  # pseudo-counts of no, nothing, yes for either class
    for _ in range(rounds):
        prior = np.array([(1 + (n * p)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(KINDS))])
        table = np.zeros((v.shape[1], 2, 3))
        for j in range(v.shape[1]):
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                c = np.bincount(v[:, j], weights=w, minlength=3) + like[y]
                table[j, y] = c / c.sum()
        log = np.log(np.stack([1 - prior[kind], prior[kind]], 1))
        for j in range(v.shape[1]):
            log += np.log(table[j][:, v[:, j]]).T
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return p, table, prior


def features(kind: np.ndarray, v: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(len(KINDS))[kind], (v == 2).astype(float), (v == 0).astype(float), shape.astype(float)], 1)


def train(x: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; counts enter by their square root, so one common pattern can't drown the rest."""
    w, weight = np.zeros(x.shape[1]), np.sqrt(n)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - q)) - ridge * w
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, g)
    return w


def fit(patterns: list[tuple[int, int]]) -> list[int]:
    """Pattern codes that the trained classifier accepts."""
    if not patterns:
        return []
    codes, n = np.array([c for c, _ in patterns]), np.array([float(c) for _, c in patterns])
    kind, v, shape = decode(codes)
    p, _, _ = reliabilities(kind, v, n)
    x = features(kind, v, shape)
    score = 1 / (1 + np.exp(-np.clip(x @ train(x, p, n), -30, 30)))
    return sorted(int(c) for c, q, s in zip(codes, score, shape, strict=True) if q >= THRESHOLD and s[3])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], *(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("found", T.ArrayType(SPAN))])
    found = durable(rows.mapInArrow(extract, schema), "pii-found")
    counted = found.select(F.explode("found.code").alias("code")).groupBy("code").count()  # at most 5 * 243 * 16 rows
    accepted = fit([(r["code"], r["count"]) for r in counted.collect()])
    take = lambda x: x["base"] | F.array_contains(F.lit(accepted).cast("array<int>"), x["code"])
    spans = F.filter("found", take)
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"], x["e"])
    return found.select(
        F.col("id").alias(id_col), *(f"n_{k}" for k in BASE), "base_sha256",
        F.array_join(F.transform(spans, name), ",").alias("spans"), F.size(F.filter(spans, lambda x: ~x["base"])).alias("n_added"), F.size(spans).cast("long").alias("n_spans"),
    )
