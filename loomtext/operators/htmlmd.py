"""HTML to Markdown and article text.

The article is the element whose paragraphs hold most text outside links. Navigation, headers, footers, asides, scripts, styles
and forms never count. Where no element stands out, the whole body is used.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrow import vectorised
from ..functions.text import trim

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style noscript template iframe svg head".split())
CHROME = frozenset("nav header footer aside form button".split())
BLOCKS = frozenset("p div section article main ul ol li table tr blockquote pre h1 h2 h3 h4 h5 h6 hr body html figure".split())
CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


class Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag, attrs=()):
        self.tag, self.attrs, self.children = tag, dict(attrs), []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        while len(self.stack) > 1 and self.stack[-1].tag in CLOSES.get(tag, ()):
            self.stack.pop()
        e = Element(tag, attrs)
        self.stack[-1].children.append(e)
        if tag not in VOID:
            self.stack.append(e)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Element(tag, attrs))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Element:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def elements(e: Element):
    todo = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, Element):
            yield x
            todo += reversed(x.children)


def text_of(e, links: bool = True) -> str:
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in DROPPED and (links or x.tag != "a"):
            todo += [" ", *reversed(x.children)] if x.tag in BLOCKS else reversed(x.children)
    return "".join(out)


def title_of(root: Element) -> str:
    return next((" ".join(text_of(_bare(e)).split()) for e in elements(root) if e.tag == "title"), "")


def _bare(e: Element) -> Element:
    out = Element("x")
    out.children = e.children
    return out


def article(root: Element) -> Element:
    """The element that scores best by its paragraphs' text without links; its parent scores half of it."""
    scores: dict[int, tuple[float, Element]] = {}
    todo: list = [(root, None, None)]
    while todo:
        e, parent, grand = todo.pop()
        if e.tag in DROPPED or e.tag in CHROME:
            continue
        if e.tag in ("p", "pre", "blockquote", "li"):
            n = len(text_of(e, links=False).strip())
            if n >= 25:
                for who, share in ((parent, 1.0), (grand, 0.5)):
                    if who is not None:
                        scores[id(who)] = (scores.get(id(who), (0.0, who))[0] + n * share, who)
        todo += [(c, e, parent) for c in e.children if isinstance(c, Element)]
    best = max(scores.values(), key=lambda s: s[0], default=(0.0, None))[1]
    return best or next((e for e in elements(root) if e.tag == "body"), root)


def _inline(e, keep_space: bool = False) -> str:
    if isinstance(e, str):
        return e if keep_space else re.sub(r"\s+", " ", e)
    if e.tag in DROPPED:
        return ""
    inner = "".join(_inline(c, keep_space) for c in e.children)
    core = inner.strip()
    if e.tag == "br":
        return "  \n"
    if e.tag in ("strong", "b") and core:
        return inner.replace(core, f"**{core}**", 1)
    if e.tag in ("em", "i") and core:
        return inner.replace(core, f"*{core}*", 1)
    if e.tag == "code" and core:
        return f"`{core}`"
    if e.tag == "a" and core:
        return f"[{core}]({e.attrs['href']})" if e.attrs.get("href") else inner
    if e.tag == "img":
        return f"![{e.attrs.get('alt') or ''}]({e.attrs['src']})" if e.attrs.get("src") else ""
    return inner


def _blocks(e: Element, out: list[str], skip: frozenset) -> None:
    line: list[str] = []

    def flush():
        if text := "".join(line).strip():
            out.append(text)
        line.clear()

    for c in e.children:
        if isinstance(c, str) or c.tag not in BLOCKS and not any(x.tag in BLOCKS for x in elements(c) if x is not c):
            if isinstance(c, str) or c.tag not in skip:
                line.append(_inline(c))
            continue
        flush()
        if c.tag in skip:
            continue
        if re.fullmatch("h[1-6]", c.tag):
            if text := _inline(_bare(c)).strip():
                out.append(f"{'#' * int(c.tag[1])} {text}")
        elif c.tag in ("ul", "ol"):
            items = []
            for k, li in enumerate([x for x in c.children if isinstance(x, Element) and x.tag == "li"], 1):
                inner: list[str] = []
                _blocks(li, inner, skip)
                mark = f"{k}. " if c.tag == "ol" else "- "
                items.append(mark + "\n".join(inner).replace("\n", "\n" + " " * len(mark)))
            if items:
                out.append("\n".join(items))
        elif c.tag == "blockquote":
            inner = []
            _blocks(c, inner, skip)
            if inner:
                out.append("> " + "\n\n".join(inner).replace("\n", "\n> "))
        elif c.tag == "pre":
            out.append("```\n" + "".join(_inline(x, True) for x in _bare(c).children).strip("\n").replace("`", "") + "\n```")
        elif c.tag == "hr":
            out.append("* * *")
        elif c.tag == "table":
            rows = [[_inline(_bare(d)).strip().replace("|", r"\|") for d in r.children if isinstance(d, Element) and d.tag in ("td", "th")] for r in elements(c) if r.tag == "tr"]
            if rows := [r for r in rows if r]:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        else:
            _blocks(c, out, skip)
    flush()


def convert(html: str | None, extract: bool = True, title: bool = True, max_length: int = 0) -> str:
    """Markdown; max_length counts bytes, cuts at a character, and goes back to a space in the second half."""
    if not html or not html.strip():
        return ""
    root = parse(html)
    out: list[str] = []
    if extract:
        if title and (t := title_of(root)):
            out.append(f"# {t}")
        _blocks(article(root), out, DROPPED | CHROME)
    else:
        _blocks(root, out, DROPPED)
    text = clean("\n\n".join(out))
    raw = text.encode()
    if max_length > 0 and len(raw) > max_length:
        text = raw[:max_length].decode(errors="ignore")
        at = text.rfind(" ")
        text = (text[:at] if len(text[: max(at, 0)].encode()) > max_length // 2 else text) + "..."
    return text


def clean(s: str) -> str:
    return re.sub("\n{4,}", "\n\n\n", s.replace("\r\n", "\n").replace("\r", "\n")).strip()


def clean_markdown(text: Column) -> Column:
    """The same, native."""
    return trim(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n{4,}", "\n\n\n"))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def markdown(html: Column, extract: bool = True, title: bool = True, max_length: int = 0) -> Column:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda h: convert(h, extract, title, max_length))

    return f(html)


@vectorised("string")
def article_text(html: pd.Series) -> pd.Series:
    """The article's text, one line for each block."""

    def one(h):
        if not h:
            return ""
        out: list[str] = []
        _blocks(article(parse(h)), out, DROPPED | CHROME)
        return "\n".join(re.sub(r"[*`#>]+ ?", "", b) for b in out).strip()

    return html.map(one)
