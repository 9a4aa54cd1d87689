"""Detection, resolution and replacement over text rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions import spans
from siftlane.functions.text import url_token
from siftlane.operators import keywords as kw
from siftlane.operators import recognizers as rec


@dataclass(frozen=True)
class Redactor:
    """What is looked for and what it becomes. Modes: keywords alone, patterns, or patterns with plug-in models."""

    entities: tuple[str, ...] = ()
    keywords: tuple[kw.Keyword, ...] = ()
    replacement: str = kw.BLOCK
    models: tuple[rec.Model | rec.Pattern, ...] = ()
    overlap: str = "keep"  # 'merge' joins partial overlaps, which otherwise are spliced one after the other
    label_urls: bool = True
    extra: dict[str, str] = field(default_factory=dict)  # replacement by entity
    regex_only: bool = False  # types that no pattern finds are left out, and models too

    def __post_init__(self) -> None:
        """A type that nothing here can find is an error, never a silent leak."""
        known = set(rec.PATTERNS).union(*((m.entities if isinstance(m, rec.Model) else {m.entity}) for m in self.models))
        missing = [] if self.regex_only else [e for e in self.entities if e not in known]
        if missing:
            rec.unavailable(f"{', '.join(missing)} (or set regex_only)")

    @property
    def mode(self) -> str:
        return "ner" if self.models and not self.regex_only else "regex" if any(e in rec.PATTERNS for e in self.entities) else "keyword"

    def recognizers(self) -> list:
        """Patterns first, then keywords, then models: their order decides ties. Only asked-for types run."""
        own = [rec.PATTERNS[e] for e in self.entities if e in rec.PATTERNS]
        asked = set(self.entities)
        models = [m for m in (() if self.regex_only else self.models) if not isinstance(m, rec.Model) or m.entities & asked]
        return own + rec.keyword_patterns(list(self.keywords)) + models

    def analyze(self, text: Column | str) -> Column:
        """Spans of all recognizers, one after the other; none in a blank text."""
        text = spans.as_column(text)
        found = [r.find(text, i) for i, r in enumerate(self.recognizers())]
        none = F.array().cast(f"array<{spans.SPAN}>")
        return F.when(spans.not_blank(text), F.concat(*found)).otherwise(none) if found else none

    def kept(self, text: Column | str) -> Column:
        out = spans.deoverlap(self.analyze(text))
        return spans.merge_overlaps(out) if self.overlap == "merge" else out

    def new_text(self, span: Column) -> Column:
        out = F.lit(self.replacement)
        for i, k in enumerate(self.keywords):
            if k.replace is not None:
                out = F.when(span["entity"] == f"KW_{i}", k.replace).otherwise(out)
        for entity, new in self.extra.items():
            out = F.when(span["entity"] == entity, new).otherwise(out)
        if "URL" in self.entities:
            token = url_token(span["text"], {k.find: k.replace or self.replacement for k in self.keywords}) if self.label_urls else F.lit("[URL]")
            out = F.when(span["entity"] == "URL", token).otherwise(out)
        return out

    def apply(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """rows with `spans` (what was kept), `redacted` and `n_redactions`. Keywords alone take a single pass."""
        if self.mode == "keyword":
            return rows.withColumn("redacted", kw.redact(text, list(self.keywords), self.replacement)).withColumn("n_redactions", kw.count(text, list(self.keywords)))
        # the spans are computed once: a column of the frame, not an expression repeated in each use
        held = rows.withColumn("spans", self.kept(text))
        return held.withColumn("redacted", spans.replace(text, F.col("spans"), self.new_text)).withColumn("n_redactions", F.size("spans").cast("long"))


def tally(rows: DataFrame, spans_column: str = "spans", ok: Column | None = None) -> DataFrame:
    """entity, matched_text and count. ok: rows that failed are left out, with all that they had matched."""
    rows = rows if ok is None else rows.where(ok)
    # explode_outer: for explode Spark infers filters on the array, and computes it anew for each of them
    found = rows.select(F.explode_outer(spans_column).alias("x")).where("x is not null")
    return found.groupBy(F.col("x.entity").alias("entity"), F.col("x.text").alias("matched_text")).agg(F.count("*").alias("count"))


def scan(rows: DataFrame, redactor: Redactor, text: str = "text") -> DataFrame:
    """Candidates for review: raw matches before overlaps are resolved, counted."""
    return tally(rows.select(redactor.analyze(text).alias("spans")))
