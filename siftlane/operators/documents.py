"""Formats that need a parser: JSON values, CSV cells, HTML and DOCX. Standard-library parsers in Arrow batches."""

from __future__ import annotations

import csv
import functools
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T
from pyspark.sql.functions import pandas_udf

SKIP_TAGS = frozenset("script style code pre".split())
_LINK = re.compile("https?://", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

#: Rows and bytes of an Arrow batch at most, where the session has Spark's own 10,000 rows and 64 MB. A worker holds a batch
#: several times over: as Arrow, as strings and as what the parser makes of them.
BATCH = {"maxRecordsPerBatch": ("10000", "1000"), "maxBytesPerBatch": ("67108864b", "8m")}


def small_batches() -> None:
    spark = SparkSession.active()
    for key, (usual, small) in BATCH.items():
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", small)


def batched(kind: T.DataType):
    """A pandas_udf in small batches, so that a worker's memory follows neither the table nor the length of its rows."""

    def made(fn):
        udf = pandas_udf(fn, kind)

        @functools.wraps(fn)
        def column(*columns) -> Column:
            small_batches()
            return udf(*columns)

        return column

    return made


def _each(fn, values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else fn(v))


# JSON
def strings(obj) -> list[str]:
    """String values in order, at any depth, without recursion; keys are left out."""
    out, stack = [], [obj]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            stack.extend(reversed(list(x.values())))
    return out


def _loads(text: str):
    try:
        return json.loads(text.removeprefix("﻿"))
    except (ValueError, RecursionError):
        return None


def walk(obj, swap, nested: bool = True):
    """obj with swap applied to every string value; a value that is a JSON object or list in text is walked inside."""
    if isinstance(obj, str):
        inner = _loads(obj) if nested and re.match(r"\s*[\[{]", obj) else None
        return json.dumps(walk(inner, swap, nested), ensure_ascii=False) if isinstance(inner, (dict, list)) else swap(obj)
    if isinstance(obj, list):
        return [walk(x, swap, nested) for x in obj]
    if isinstance(obj, dict):
        return {k: walk(v, swap, nested) for k, v in obj.items()}
    return obj


@batched(T.ArrayType(T.StringType()))
def json_strings(texts: pd.Series) -> pd.Series:
    """String values of a JSON text; null if it doesn't parse."""
    return _each(lambda t: None if (x := _loads(t)) is None else strings(x), texts)


def json_redact(text: Column | str, swap, nested: bool = True, indent: int | None = 2) -> Column:
    """A JSON text with its string values swapped and written anew; null if it doesn't parse. swap: str -> str, run in
    Arrow batches (nesting has no bound, so that no column expression can do it)."""

    @batched(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str):
            x = _loads(t)
            if x is None:
                return None
            out = json.dumps(walk(x, swap, nested), ensure_ascii=False, indent=indent)
            return out + "\n" if indent else out

        return _each(one, texts)

    return run(text)


# CSV
@batched(T.ArrayType(T.ArrayType(T.StringType())))
def csv_cells(texts: pd.Series) -> pd.Series:
    """Rows of cells; rows may differ in length and nothing is a header."""
    return _each(lambda t: list(csv.reader(io.StringIO(t.removeprefix("﻿"), newline=""))), texts)


@batched(T.StringType())
def csv_text(cells: pd.Series) -> pd.Series:
    def one(rows) -> str:
        out = io.StringIO(newline="")
        csv.writer(out).writerows(list(r) for r in rows)
        return out.getvalue()

    return _each(one, cells)


def redact_cells(cells: Column, new) -> Column:
    """new: Column -> Column, for every cell."""
    return F.transform(cells, lambda row: F.transform(row, new))


# HTML
class _Rewriter(HTMLParser):
    """Writes HTML out again with text and link targets swapped. Text straight below SKIP_TAGS stays as it is."""

    def __init__(self, text, href, label):
        super().__init__(convert_charrefs=True)
        self.text, self.href, self.label = text, href, label
        self.out: list[str] = []
        self.open: list[str] = []
        self.links: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        link = dict(attrs).get("href") if tag == "a" else None
        if link is not None:
            self.links.append((link, []))
            attrs = [(k, self.href(v) if k == "href" and v else v) for k, v in attrs]
        self.out.append("<" + tag + "".join(f" {k}" if v is None else f' {k}="{escape(v)}"' for k, v in attrs) + ">")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag == "a" and self.links:
            link, text = self.links.pop()
            if self.label and _LINK.match(link.strip()) and not _LINK.search("".join(text)):
                self.out.append(" " + escape(self.label(link), quote=False))
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass
        self.out.append(f"</{tag}>")

    def handle_data(self, data):
        for _, text in self.links:
            text.append(data)
        parent = self.open[-1] if self.open else ""
        raw = parent in ("script", "style")
        self.out.append(data if raw else escape(data if parent in SKIP_TAGS else self.text(data), quote=False))

    def handle_comment(self, data):
        self.out.append(f"<!--{self.text(data)}-->")

    def handle_decl(self, decl):
        self.out.append(f"<!{decl}>")


def rewrite_html(html: str, text, href, label=None) -> str:
    p = _Rewriter(text, href, label)
    p.feed(html)
    p.close()
    return "".join(p.out)


def html_redact(html: Column | str, text, href, label=None) -> Column:
    """HTML with text and hrefs swapped (str -> str each); label: url -> what is put after a link's own words."""

    @batched(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        return _each(lambda h: rewrite_html(h, text, href, label), pages)

    return run(html)


class _Reader(HTMLParser):
    """Visible text, links, and Markdown with # headings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words: list[str] = []
        self.links: list[str] = []
        self.md: list[str] = []
        self.hidden: list[str] = []
        self.href: list[str | None] = []
        self.lists: list[list] = []
        self.cells = -1

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "head"):
            self.hidden.append(tag)
        elif re.fullmatch("h[1-6]", tag):
            self.md.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "blockquote"):
            self.md.append("\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.md.append("\n")
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "* "
            self.md.append("\n" + "  " * max(0, len(self.lists) - 1) + mark)
        elif tag == "br":
            self.md.append("  \n")
        elif tag == "hr":
            self.md.append("\n\n---\n\n")
        elif tag in ("b", "strong"):
            self.md.append("**")
        elif tag in ("i", "em"):
            self.md.append("*")
        elif tag == "code":
            self.md.append("`")
        elif tag == "tr":
            self.md.append("\n|")
        elif tag in ("td", "th"):
            self.md.append(" ")
        if tag == "a":
            self.href.append(a.get("href"))
            if a.get("href") is not None:
                self.links.append(a["href"])
                self.md.append("[")

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif re.fullmatch("h[1-6]", tag) or tag in ("p", "div", "section", "article", "table", "blockquote"):
            self.md.append("\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.md.append("\n")
        elif tag in ("b", "strong"):
            self.md.append("**")
        elif tag in ("i", "em"):
            self.md.append("*")
        elif tag == "code":
            self.md.append("`")
        elif tag in ("td", "th"):
            self.md.append(" |")
        elif tag == "a" and self.href:
            target = self.href.pop()
            if target is not None:
                self.md.append(f"]({target})")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)
            self.md.append(re.sub(r"\s+", " ", data))


def read_html(html: str) -> _Reader:
    r = _Reader()
    r.feed(html)
    r.close()
    return r


@batched(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Visible text, white space collapsed."""
    return _each(lambda h: " ".join(" ".join(read_html(h).words).split()), pages)


@batched(T.ArrayType(T.StringType()))
def html_links(pages: pd.Series) -> pd.Series:
    return _each(lambda h: read_html(h).links, pages)


@batched(T.StringType())
def html_markdown(pages: pd.Series) -> pd.Series:
    """Markdown of a page: script, style and head left out, no more than one blank line running."""

    def one(h: str) -> str:
        text = re.sub(r"[ \t]+\n(?!\n)", lambda m: m.group() if m.group().startswith("  ") else "\n", "".join(read_html(h).md))
        return re.sub(r"\n\s*\n+", "\n\n", text).strip() + "\n"

    return _each(one, pages)


# DOCX
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _on(run, name: str) -> bool:
    mark = run.find(f"{_W}rPr/{_W}{name}")
    return mark is not None and mark.get(f"{_W}val") not in ("0", "false", "none")


def _words(node) -> str:
    return "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in node.iter())


def _paragraph(p, styles: dict[str, str]) -> str:
    mark = p.find(f"{_W}pPr/{_W}pStyle")
    style = styles.get(mark.get(f"{_W}val"), "") if mark is not None else ""
    out = ""
    for run in p.findall(f"{_W}r"):
        text = _words(run)
        stars = "*" * (2 * _on(run, "b") + _on(run, "i"))
        out += f"{stars}{text}{stars}" if text else ""
    out = out or _words(p).strip()
    if not out.strip():
        return ""
    level = re.match(r"heading ([1-4])", style, re.I)
    if level:
        return "#" * int(level.group(1)) + " " + out
    return f"- {out}" if "Bullet" in style or "List" in style else out


def docx_to_markdown(content: bytes) -> str:
    """Paragraphs and tables in document order, with headings, lists, bold and italic."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).findall(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    out: list[str] = []
    for child in body:
        if child.tag == f"{_W}p":
            out.append(_paragraph(child, styles))
        elif child.tag == f"{_W}tbl":
            rows = [[" ".join("\n".join(_words(p) for p in c.findall(f"{_W}p")).strip().split("\n")) for c in r.findall(f"{_W}tc")] for r in child.findall(f"{_W}tr")]
            table = ["| " + " | ".join(r) + " |" for r in rows]
            if rows:
                table.insert(1, "| " + " | ".join("---" for _ in rows[0]) + " |")
            out += ["", *table, ""]
    kept = [x for i, x in enumerate(out) if x.strip() or i == 0 or out[i - 1].strip()]
    return "\n".join(kept).strip() + "\n"


@batched(T.StringType())
def docx_markdown(contents: pd.Series) -> pd.Series:
    return _each(lambda b: docx_to_markdown(bytes(b)), contents)


def converted_name(path: Column | str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(".md"))


def convert(files: DataFrame) -> DataFrame:
    """path and markdown of the .docx and .html files of (path, content)."""
    docx = files.where(F.lower("path").endswith(".docx")).select(converted_name("path").alias("path"), docx_markdown("content").alias("markdown"))
    html = files.where(F.lower("path").rlike(r"\.html?$")).select(converted_name("path").alias("path"), html_markdown(F.make_valid_utf8(F.col("content").cast("string"))).alias("markdown"))
    return docx.unionByName(html)
