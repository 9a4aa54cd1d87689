"""Renaming of paths: keywords in names become their pseudonyms, collisions get numbers, leaks are flagged."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlane.functions import spans
from siftlane.functions.text import stem, suffix
from siftlane.operators.keywords import Keyword, pattern

MIN_LENGTH = 4


def split_keywords(keywords: list[Keyword], min_length: int = MIN_LENGTH) -> tuple[list[Keyword], list, list]:
    """Aliased keywords, plain terms, and terms too short to be matched in names."""
    long = [k for k in keywords if len(k.find) >= min_length]
    short = sorted({k.find for k in keywords if len(k.find) < min_length})
    return [k for k in long if k.replace is not None], sorted({k.find for k in long if k.replace is None}), short


def safe_name(pseudonym: str) -> str:
    """text.sanitize() for one value on the driver."""
    import re

    return re.sub("_+", "_", re.sub("[^a-zA-Z0-9_.-]+", "_", pseudonym)).strip("_") or "REDACTED"


def _renamed(part: Column, aliased: list[Keyword]) -> Column:
    p = pattern(aliased, boundary=False)
    by = F.create_map(*(F.lit(x) for k in aliased for x in (k.find.lower(), safe_name(k.replace))))
    new = F.transform(spans.matches(part, p), lambda m: F.coalesce(F.try_element_at(by, F.lower(m)), F.lit("REDACTED")))
    zipped = F.arrays_zip(F.split(part, p).alias("g"), new.alias("m"))
    return F.array_join(F.flatten(F.transform(zipped, lambda z: F.array(z["g"], F.coalesce(z["m"], F.lit(""))))), "")


def rename(files: DataFrame, keywords: list[Keyword], min_length: int = MIN_LENGTH) -> DataFrame:
    """path, renamed and hits: every folder, and the name without its last extension, with substrings replaced."""
    aliased, _, _ = split_keywords(keywords, min_length)
    if not aliased:
        return files.select("path", F.col("path").alias("renamed"), F.lit(0).cast("long").alias("hits"))
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    new = F.concat(F.transform(folders, lambda d: _renamed(d, aliased)), F.array(F.concat(_renamed(stem("path"), aliased), suffix("path"))))
    p = pattern(aliased, boundary=False)
    hits = F.aggregate(F.concat(folders, F.array(stem("path"))), F.lit(0), lambda acc, d: acc + F.size(spans.matches(d, p)))
    return files.select("path", F.array_join(new, "/").alias("renamed"), hits.cast("long").alias("hits"))


def _numbered(path: Column, n: Column) -> Column:
    ext = suffix(path)
    return F.concat(F.substr(path, F.lit(1), F.length(path) - F.length(ext)), F.lit("__"), n.cast("string"), ext)


def resolve_collisions(renamed: DataFrame) -> DataFrame:
    """path, renamed, hits and final: of equal names the first by path keeps it, later ones get __2, __3 and so on.

    Numbers are a window's row number. Only where a numbered name is some file's own name is the whole folder's
    numbering done in order, so that two files never share one; everything else stays in columns."""
    nth = F.row_number().over(Window.partitionBy("renamed").orderBy("path"))
    plan = renamed.withColumn("nth", nth).withColumn("final", F.when(F.col("nth") == 1, F.col("renamed")).otherwise(_numbered(F.col("renamed"), F.col("nth"))))
    folder = F.regexp_replace("renamed", "[^/]*$", "")
    plan = plan.withColumn("folder", folder)
    clash = plan.groupBy("folder", "final").agg(F.count("*").alias("n")).where("n > 1").select("folder").distinct()
    fine = plan.join(clash, "folder", "left_anti").select("path", "renamed", "hits", "final")
    again = plan.join(clash, "folder", "left_semi").select("path", "renamed", "hits", "folder")
    fixed = again.groupBy("folder").applyInPandas(_in_order, "path string, renamed string, hits long, final string")
    return fine.unionByName(fixed)


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    own, used, final = set(rows["renamed"]), set(), []
    rows = rows.sort_values("path")
    for name in rows["renamed"]:
        new, n = name, 2
        cut = name.rfind(".") if name.rfind(".") > name.rfind("/") + 1 else len(name)
        while new in used or (n > 2 and new in own):
            new, n = f"{name[:cut]}__{n}{name[cut:]}", n + 1
        used.add(new)
        final.append(new)
    return rows.assign(final=final)[["path", "renamed", "hits", "final"]]


def flags(plan: DataFrame, keywords: list[Keyword], min_length: int = MIN_LENGTH) -> DataFrame:
    """final and terms: names that still hold plain keywords, which have no pseudonym."""
    _, plain, _ = split_keywords(keywords, min_length)
    terms = F.filter(F.array(*map(F.lit, plain)).cast("array<string>"), lambda t: F.lower("final").contains(F.lower(t)))
    return plan.select("final", terms.alias("terms")).where(F.size("terms") > 0)


def summary(plan: DataFrame, keywords: list[Keyword], min_length: int = MIN_LENGTH) -> DataFrame:
    """One row: files_renamed, dirs_renamed (folders whose own path changes), collisions and flagged_files."""
    leak = F.size(F.filter(F.array(*map(F.lit, split_keywords(keywords, min_length)[1])).cast("array<string>"), lambda t: F.lower("final").contains(F.lower(t)))) > 0
    totals = plan.agg(
        F.coalesce(F.sum((F.col("path") != F.col("final")).cast("long")), F.lit(0)).alias("files_renamed"),
        F.coalesce(F.sum((F.col("renamed") != F.col("final")).cast("long")), F.lit(0)).alias("collisions"),
        F.coalesce(F.sum(leak.cast("long")), F.lit(0)).alias("flagged_files"),
    )
    a, b = F.split("path", "/"), F.split("renamed", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(a)), lambda n: F.struct(F.array_join(F.slice(a, 1, n), "/").alias("old"), (F.element_at(a, n) != F.element_at(b, n)).alias("changed")))
    dirs = plan.select(F.explode(F.slice(up, 1, F.size(a) - 1)).alias("d")).where("d.changed").agg(F.countDistinct("d.old").alias("dirs_renamed"))
    return totals.crossJoin(dirs)


def render_map(rows: list) -> str:
    return "\n".join(["# Renamed files — keep local: original names", *(f"{r['path']}\t->\t{r['final']}" for r in rows)]) + "\n"


def render_flags(rows: list) -> str:
    return "\n".join(["# Names that still hold a plain keyword — keep local", *(f"{r['final']}\t{', '.join(r['terms'])}" for r in rows)]) + "\n"
