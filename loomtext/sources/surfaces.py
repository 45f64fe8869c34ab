"""Text that a reader doesn't see: in HTML, DOCX, XLSX and PDF files. Arrow UDFs, since these are file formats."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import vectorised

SURFACES = "array<struct<source:string,text:string>>"

# Meta names that say nothing; tags without content; tags whose content is raw or escapable text.
SKIPPED_META = frozenset(["viewport", "charset", "robots", "theme-color", "msapplication-tilecolor"])
RAW = ("script", "style", "noscript", "iframe", "noembed", "noframes", "xmp")
ESCAPABLE = ("textarea", "title")


class _Walk(HTMLParser):
    CDATA_CONTENT_ELEMENTS = RAW

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.open: list | None = None  # [tag, place in found, text so far]

    def add(self, source: str, text: str | None) -> None:
        if text and text.strip():
            self.found.append((source, text.strip()))

    def handle_comment(self, data):
        if self.open is None:
            self.add("html:comment", data)

    def handle_starttag(self, tag, attrs):
        if self.open is not None and self.open[0] in ESCAPABLE:
            self.open[2] += self.get_starttag_text() or ""
            return
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "meta":
            name = a.get("name") or a.get("property") or ""
            if a.get("content") and name.lower() not in SKIPPED_META:
                self.add("html:meta", f"{name}: {a['content']}")
        elif tag in ("noscript", "textarea"):
            self.open = [tag, len(self.found), ""]
        elif tag == "input":
            if a.get("type", "").lower() == "hidden":
                self.add("html:hidden-input", a.get("value"))
            self.add("html:placeholder", a.get("placeholder"))
        else:
            self.add("html:placeholder", a.get("placeholder"))
        if tag in ("img", "area"):
            self.add("html:alt", a.get("alt"))
        self.add("html:aria-label", a.get("aria-label"))
        self.add("html:title-attr", a.get("title"))
        for k, v in a.items():
            if k.startswith("data-") and len(v.strip().encode()) > 20:
                self.add("html:data-attr", f"{k}={v}")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.open is None:
            return
        if tag == self.open[0]:
            self.close_open()
        else:
            self.open[2] += f"</{tag}>"

    def handle_data(self, data):
        if self.open is not None:
            self.open[2] += data

    def close_open(self):
        tag, at, text = self.open
        self.open = None
        if text.strip():
            self.found.insert(at, (f"html:{tag}", text.strip()))


def html_surfaces_of(html: str | None) -> list[tuple[str, str]]:
    w = _Walk()
    w.feed(html or "")
    w.close()
    if w.open is not None:
        w.close_open()
    return w.found


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


# Fields of the property files, in order.
CORE, APP = ("title", "subject", "description", "keywords", "creator"), ("Manager", "Company")


def _properties(data: bytes, source: str, names) -> list[tuple[str, str]]:
    root = ET.fromstring(data)
    by = {_local(e.tag): (e.text or "").strip() for e in root}
    return [(source, f"{n.lower()}: {by[n]}") for n in names if by.get(n)]


def _texts(root: ET.Element, name: str, source: str) -> list[tuple[str, str]]:
    return [(source, e.text.strip()) for e in root.iter() if _local(e.tag) == name and e.text and e.text.strip()]


def _hidden_runs(root: ET.Element) -> list[tuple[str, str]]:
    out = []
    for run in root.iter():
        if _local(run.tag) == "r" and any(_local(p.tag) == "rPr" and any(_local(h.tag) in ("vanish", "hidden") for h in p) for p in run):
            out += _texts(run, "t", "docx:hidden")
    return out


def office_surfaces_of(data: bytes | None, kind: str) -> list[tuple[str, str]]:
    """In the order of the archive's entries; what can't be read gives nothing."""
    out: list[tuple[str, str]] = []
    try:
        archive = zipfile.ZipFile(io.BytesIO(data or b""))
    except (zipfile.BadZipFile, ValueError):
        return out
    for name in archive.namelist():
        try:
            if name == "docProps/core.xml":
                out += _properties(archive.read(name), f"{kind}:property", CORE)
            elif name == "docProps/app.xml":
                out += _properties(archive.read(name), f"{kind}:property", APP)
            elif kind == "docx" and name == "word/comments.xml":
                out += _texts(ET.fromstring(archive.read(name)), "t", "docx:comment")
            elif kind == "docx" and name == "word/document.xml":
                root = ET.fromstring(archive.read(name))
                out += _hidden_runs(root) + _texts(root, "instrText", "docx:field-code")
            elif kind == "xlsx" and re.fullmatch(r"xl/comments.*\.xml", name):
                out += _texts(ET.fromstring(archive.read(name)), "t", "xlsx:comment")
        except (ET.ParseError, zipfile.BadZipFile, RuntimeError, OSError):
            continue
    return out


# What is read from a PDF.
XMP_FIELD = re.compile(rb"<(?:dc:|pdf:|xmp:)?(?:title|description|subject|Keywords|Creator)[^>]*>([^<]{4,})<", re.S)
PDF_INFO = re.compile(rb"/(?:Title|Subject|Author|Keywords|Creator|Producer)[\t\n\f\r ]*\(([^)]{4,})\)")
PDF_SCRIPT = re.compile(rb"/JS[\t\n\f\r ]*\(([^)]{10,})\)")


def _utf8(b: bytes) -> str:
    try:
        return b.decode().strip()
    except UnicodeDecodeError:
        return ""


def _xmp(packet: bytes) -> list[tuple[str, str]]:
    try:
        root = ET.fromstring(re.sub(rb"<\?xpacket.*?\?>", b"", packet, flags=re.S).strip())
    except ET.ParseError:
        return [("pdf:metadata", t) for m in XMP_FIELD.findall(packet) if (t := _utf8(m))]
    out = []
    for d in (e for e in root.iter() if _local(e.tag) == "Description"):
        for field in d:
            name = _local(field.tag).lower()
            if name in ("title", "description", "subject"):
                out += [("pdf:metadata", f"{name}: {t.strip()}") for li in field.iter() if _local(li.tag) == "li" and (t := li.text or "").strip()]
            elif name == "keywords" and (field.text or "").strip():
                out.append(("pdf:metadata", f"keywords: {field.text.strip()}"))
    return out


def pdf_surfaces_of(data: bytes | None) -> list[tuple[str, str]]:
    data, out = data or b"", []
    start, end = data.find(b"<?xpacket"), data.rfind(b"<?xpacket end")
    if 0 <= start < end and (close := data.find(b"?>", end)) >= 0:
        out += _xmp(data[start : close + 2])
    out += [("pdf:metadata", t) for m in PDF_INFO.findall(data) if (t := _utf8(m))]
    out += [("pdf:javascript", t) for m in PDF_SCRIPT.findall(data) if (t := _utf8(m))]
    return out


def _rows(found):
    return [{"source": s, "text": t} for s, t in found]


@vectorised(SURFACES)
def html_surfaces(html: pd.Series) -> pd.Series:
    return html.map(lambda h: _rows(html_surfaces_of(h)))


@vectorised(SURFACES)
def file_surfaces(path: pd.Series, content: pd.Series) -> pd.Series:
    """By the ending of the path: .docx, .xlsx or .xls, .pdf, .html or .htm; others have none."""

    def one(p: str, c: bytes):
        ending = (p or "").lower().rpartition(".")[2]
        if ending == "docx":
            return office_surfaces_of(c, "docx")
        if ending in ("xlsx", "xls"):
            return office_surfaces_of(c, "xlsx")
        if ending == "pdf":
            return pdf_surfaces_of(c)
        return html_surfaces_of(bytes(c or b"").decode(errors="replace")) if ending in ("html", "htm") else []

    return pd.Series([_rows(one(p, c)) for p, c in zip(path, content, strict=True)])


def surface_table(docs: DataFrame, surfaces: Column, *keys: str) -> DataFrame:
    """keys, surface_idx, source, text."""
    return docs.select(*keys, F.posexplode(surfaces).alias("surface_idx", "s")).select(*keys, "surface_idx", "s.source", "s.text")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file below."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
