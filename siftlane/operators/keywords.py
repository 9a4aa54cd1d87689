"""Keyword tables and the single-pass keyword redactor."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlane.functions import spans
from siftlane.functions.text import strip

BLOCK = "█████"


@dataclass(frozen=True)
class Keyword:
    find: str
    replace: str | None = None


def normalize(entries: list) -> list[Keyword]:
    """Strings and {find, replace} as keywords, in order; without a find an entry is left out."""
    out = []
    for e in entries or []:
        k = Keyword(e) if isinstance(e, str) else Keyword(str(e.get("find") or ""), e.get("replace"))
        if k.find:
            out.append(k)
    return out


def validate(entries: list) -> list[Keyword]:
    """Entries of a mapping file: every one with non-empty find and replace, finds unique but for case."""
    if not isinstance(entries, list):
        raise ValueError("mappings must be a list")
    seen = set()
    for i, e in enumerate(entries):
        if not isinstance(e, dict) or not all(isinstance(e.get(k), str) and e[k] for k in ("find", "replace")):
            raise ValueError(f"mapping {i} needs a non-empty find and replace")
        if e["find"].lower() in seen:
            raise ValueError(f"duplicate find: {e['find']!r}")
        seen.add(e["find"].lower())
    return [Keyword(e["find"], e["replace"]) for e in entries]


def quoted(term: str) -> str:
    """A term as a literal for Java's and Python's regular expressions alike."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def pattern(keywords: list[Keyword], boundary: bool = True) -> str:
    """One alternation, longest find first."""
    alts = "|".join(quoted(k.find) for k in sorted(keywords, key=lambda k: -len(k.find)))
    b = r"\b" if boundary else ""
    return f"{spans.FLAGS}{b}(?:{alts}){b}"


def _lookup(keywords: list[Keyword], value) -> Column:
    pairs: dict[str, object] = {}
    for k in keywords:
        pairs[k.find.lower()] = value(k)
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def redact(text: Column | str, keywords: list[Keyword], default: str = BLOCK, boundary: bool = True) -> Column:
    """Every keyword replaced in one pass, case ignored; a replacement is never matched again."""
    text = spans.as_column(text)
    if not keywords:
        return text
    p = pattern(keywords, boundary)
    by = _lookup(keywords, lambda k: default if k.replace is None else k.replace)
    gaps = F.split(text, p)
    # a match that folds to a find without lower-casing to it (long s) keeps the default
    new = F.transform(spans.matches(text, p), lambda m: F.coalesce(F.try_element_at(by, F.lower(m)), F.lit(default)))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), new.alias("m")), lambda z: F.array(z["g"], F.coalesce(z["m"], F.lit(""))))), "")


def count(text: Column | str, keywords: list[Keyword], boundary: bool = True) -> Column:
    return F.size(spans.matches(text, pattern(keywords, boundary))).cast("long") if keywords else F.lit(0).cast("long")


def hits(docs: DataFrame, text: str, keywords: list[Keyword], boundary: bool = True) -> DataFrame:
    """One row for every match: docs' columns, find (as in the table), replace and matched."""
    by = _lookup(keywords, lambda k: k.find)
    rep = F.create_map(*(x for k in keywords for x in (F.lit(k.find), F.lit(k.replace).cast("string"))))
    rows = docs.select("*", F.explode(spans.matches(text, pattern(keywords, boundary))).alias("matched"))
    return rows.withColumn("find", F.try_element_at(by, F.lower("matched"))).withColumn("replace", F.try_element_at(rep, F.col("find")))


def counts(docs: DataFrame, text: str, keywords: list[Keyword]) -> DataFrame:
    """find and count, over all rows."""
    return hits(docs.select(text), text, keywords).groupBy("find").agg(F.count("*").alias("count"))


def table(spark: SparkSession, keywords: list[Keyword]) -> DataFrame:
    return spark.createDataFrame([(i, k.find, k.replace) for i, k in enumerate(keywords)], "idx int, find string, replace string")


# names list -> codes
def name_terms(lines: DataFrame) -> DataFrame:
    """Terms of a names list from (lineno, line): lineno, header, pos and term. A '# X' line names the group of the
    lines after it; a line's comma-separated terms are aliases of one person. Lines before any header give none."""
    w = Window.orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    row = lines.select("lineno", strip("line").alias("line")).where("line <> ''")
    header = F.when(F.col("line").startswith("#"), strip(F.regexp_replace("line", "^#+", "")))
    row = row.withColumn("is_header", F.col("line").startswith("#")).withColumn("header", header)
    # an empty header keeps the one before it out of force
    row = row.withColumn("group", F.last("header", ignorenulls=True).over(w)).where("not is_header and group <> ''")
    body = F.when(F.col("line").rlike("^[-*] "), strip(F.substr("line", F.lit(3)))).otherwise(F.col("line"))
    parts = F.filter(F.transform(F.split(body, ","), strip), lambda t: t != "")
    return row.select("lineno", F.col("group").alias("header"), F.posexplode(parts).alias("pos", "term"))


def codes(lines: DataFrame) -> DataFrame:
    """lineno, pos, find and code of every term: '[PREFIX-NN]', NN numbering the lines of a group; null for BLACKOUT."""
    t = name_terms(lines)
    black = F.lower("header") == "blackout"
    prefix = F.regexp_replace("header", r"^[\[\] ]+|[\[\] ]+$", "")
    number = F.dense_rank().over(Window.partitionBy("header").orderBy("lineno"))
    code = F.when(~black, F.concat(F.lit("["), prefix, F.lit("-"), F.lpad(number.cast("string"), 2, "0"), F.lit("]")))
    wide = F.when(~black & (number > 99), F.concat(F.lit("["), prefix, F.lit("-"), number.cast("string"), F.lit("]"))).otherwise(code)
    return t.select("lineno", "pos", F.col("term").alias("find"), wide.alias("code"))


def duplicate_finds(lines: DataFrame) -> DataFrame:
    """find (lower case) and n of the terms that a names list has more than once."""
    return name_terms(lines).groupBy(F.lower("term").alias("find")).agg(F.count("*").alias("n")).where("n > 1")


def yaml_entries(rows: list) -> str:
    """Collected codes() rows as the entries of a configuration's keyword list."""
    import json

    out = []
    for r in sorted(rows, key=lambda r: (r["lineno"], r["pos"])):
        find = json.dumps(r["find"], ensure_ascii=False)
        out += [f"  - {find}"] if r["code"] is None else [f"  - find: {find}", f"    replace: {json.dumps(r['code'], ensure_ascii=False)}"]
    return "\n".join(out)


def splice(text: str, entries: str, begin: str, end: str) -> str:
    """text with the lines strictly between its two marker lines replaced by entries."""
    rows = text.split("\n")
    a, b = (next((i for i, r in enumerate(rows) if m in r), None) for m in (begin, end))
    if a is None or b is None or b < a:
        raise ValueError("markers not found in order")
    return "\n".join([*rows[: a + 1], *([entries] if entries else []), *rows[b:]])
