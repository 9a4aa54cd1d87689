"""Redaction inside JSON, CSV and HTML by the same column expressions as plain text.

A parser takes a document's texts out, in order, in one Arrow batch; the redactor's expressions run on that array without a
shuffle; the parser puts the new texts back. Keys, markup and numbers never reach the redactor.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlane.functions import spans
from siftlane.functions.text import url_token
from siftlane.operators import keywords as kw
from siftlane.operators.documents import _loads, batched, json, redact_cells, rewrite_html, walk
from siftlane.operators.redact import Redactor

_STRINGS = T.ArrayType(T.StringType())


def _take_json(text: str, nested: bool) -> list[str] | None:
    obj, out = _loads(text), []
    if obj is None:
        return None
    walk(obj, lambda s: out.append(s) or s, nested)
    return out


def _put_json(text: str, new, nested: bool) -> str | None:
    obj, it = _loads(text), iter(new if new is not None else ())
    return None if obj is None else json.dumps(walk(obj, lambda _: next(it), nested), ensure_ascii=False, indent=2) + "\n"


@batched(T.BooleanType())
def parses(texts: pd.Series) -> pd.Series:
    """Is it JSON?"""
    return texts.map(lambda t: t is not None and _loads(t) is not None)


def _take_html(text: str) -> tuple[list[str], list[str]]:
    """Texts, and link targets (each once as href and, where a label is asked for, once more)."""
    texts, links = [], []
    rewrite_html(text, lambda s: texts.append(s) or s, lambda h: links.append(h) or h, lambda h: "")
    return texts, links


def _put_html(text: str, texts, hrefs, labels: dict[str, str] | None) -> str:
    a, b = iter(texts), iter(hrefs)
    return rewrite_html(text, lambda _: next(a), lambda _: next(b), labels.__getitem__ if labels else None)


def _new(redactor: Redactor, text: Column, kept: Column) -> Column:
    if redactor.mode == "keyword":
        return kw.redact(text, list(redactor.keywords), redactor.replacement)
    return spans.splice(text, kept, redactor.new_text)


def _all(rows: DataFrame, leaves: str, redactor: Redactor) -> DataFrame:
    """rows with new_<leaves> and n_<leaves>."""
    if redactor.mode == "keyword":
        n = F.aggregate(leaves, F.lit(0).cast("long"), lambda acc, x: acc + kw.count(x, list(redactor.keywords)))
        return rows.withColumn(f"new_{leaves}", F.transform(leaves, lambda x: _new(redactor, x, x))).withColumn(f"n_{leaves}", n)
    rows = rows.withColumn("kept", F.transform(leaves, redactor.kept))
    new = F.transform(F.arrays_zip(F.col(leaves).alias("t"), F.col("kept").alias("k")), lambda z: _new(redactor, z["t"], z["k"]))
    n = F.aggregate("kept", F.lit(0).cast("long"), lambda acc, k: acc + F.size(k))
    return rows.withColumn(f"new_{leaves}", new).withColumn(f"n_{leaves}", n).drop("kept")


def redact_json(rows: DataFrame, redactor: Redactor, nested: bool = True) -> DataFrame:
    """(path, text) with redacted and n_redactions: string values only, JSON inside them too. Null where it doesn't parse."""

    @batched(_STRINGS)
    def take(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _take_json(t, nested))

    @batched(T.StringType())
    def put(texts: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _put_json(t, n, nested) for t, n in zip(texts, new, strict=True)])

    held = _all(rows.withColumn("leaves", take("text")), "leaves", redactor)
    return held.select("path", put("text", "new_leaves").alias("redacted"), F.coalesce("n_leaves", F.lit(0)).alias("n_redactions"))


def redact_html(rows: DataFrame, redactor: Redactor) -> DataFrame:
    """(path, text) with redacted and n_redactions: visible texts, and link targets, whose URLs become a plain [URL]; a link
    whose own words are no URL gets its service's label behind them."""
    both = T.StructType([T.StructField("texts", _STRINGS), T.StructField("links", _STRINGS)])

    @batched(both)
    def take(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_take_html(t or "") for t in texts], columns=["texts", "links"])

    labelled = "URL" in redactor.entities

    @batched(T.StringType())
    def put(texts: pd.Series, new: pd.Series, links: pd.Series, hrefs: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else _put_html(t, n, h, dict(zip(k, b, strict=True)) if labelled else None)
            for t, n, k, h, b in zip(texts, new, links, hrefs, labels, strict=True)
        ])

    held = rows.withColumn("x", take("text")).select("path", "text", F.col("x.texts").alias("texts"), F.col("x.links").alias("links"))
    plain = Redactor(redactor.entities, redactor.keywords, redactor.replacement, redactor.models, redactor.overlap, False, redactor.extra, redactor.regex_only)
    held = _all(_all(held, "texts", redactor), "links", plain)
    aliases = {k.find: k.replace or redactor.replacement for k in redactor.keywords}
    labels = F.transform("links", lambda u: url_token(u, aliases))
    return held.select("path", put("text", "new_texts", "links", "new_links", labels).alias("redacted"), (F.col("n_texts") + F.col("n_links")).alias("n_redactions"))


def redact_csv(rows: DataFrame, redactor: Redactor) -> DataFrame:
    """(path, cells) with cells redacted and n_redactions; the first row is a row like any other."""
    flat = rows.withColumn("leaves", F.flatten("cells"))
    n = _all(flat, "leaves", redactor)
    new = redact_cells(F.col("cells"), lambda x: _new(redactor, x, x if redactor.mode == "keyword" else redactor.kept(x)))
    return n.select("path", new.alias("cells"), F.col("n_leaves").alias("n_redactions"))


def leaf_rows(text: DataFrame, html: DataFrame, js: DataFrame, csv: DataFrame, nested: bool = True) -> DataFrame:
    """(path, text), a row for every text that the redactor sees in files of all formats: what a report counts."""

    @batched(_STRINGS)
    def from_html(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [x for part in _take_html(t or "") for x in part])

    @batched(_STRINGS)
    def from_json(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _take_json(t, nested))

    out = text.select("path", "text")
    for rows in (html.select("path", from_html("text").alias("x")), js.select("path", from_json("text").alias("x")), csv.select("path", F.flatten("cells").alias("x"))):
        out = out.unionByName(rows.select("path", F.explode("x").alias("text")))
    return out
