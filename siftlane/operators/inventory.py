"""Inventories of a tree of files or of any table of (path, content): finds, routes, duplicates, empty folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions.text import file_name, stem, suffix

SKIPPED_DIRS = ("node_modules", "__pycache__", "venv", "dist", "build")
HANDLERS = {".md": "md", ".txt": "txt", ".html": "html", ".htm": "html", ".json": "json", ".csv": "csv", ".pdf": "pdf", ".png": "img", ".jpg": "img", ".jpeg": "img"}


def find_by_extension(files: DataFrame, ext: str) -> DataFrame:
    """Paths whose name ends in ext (its dot may be left out), directories included; case counts."""
    ext = ext if ext.startswith(".") else f".{ext}"
    return files.where(file_name("path").endswith(ext))


def normalize_extensions(exts: list[str] | None) -> list[str]:
    clean = [e.strip().lower() for e in exts or [] if e and e.strip()]
    return [e if e.startswith(".") else f".{e}" for e in clean]


def route(path: Column | str, include: list[str] | None = None, skip: list[str] | None = None, copy_unhandled: bool = False) -> Column:
    """What becomes of a file: 'skip' (skip comes first and is taken as written), the handler's name, or, unhandled,
    'copied' or 'uncopied'."""
    ext = F.lower(suffix(path))
    allowed = normalize_extensions(include)
    by = F.lit(None).cast("string")
    for e, name in HANDLERS.items():
        by = F.when(ext == e, name).otherwise(by)
    out = F.coalesce(by, F.lit("copied" if copy_unhandled else "uncopied"))
    if allowed:
        out = F.when(~ext.isin(*allowed), F.lit("skip")).otherwise(out)
    return F.when(ext.isin(*skip), F.lit("skip")).otherwise(out) if skip else out


def route_stats(files: DataFrame, **how) -> DataFrame:
    return files.groupBy(route("path", **how).alias("kind")).agg(F.count("*").alias("n"))


def own_output(rel: Column | str, base: str) -> Column:
    """Is the path one of our outputs: below a folder named base or base-*, or a redaction report?"""
    rel = F.col(rel) if isinstance(rel, str) else rel
    parts = F.split(rel, "/")
    folder = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: (p == base) | p.startswith(f"{base}-"))
    return folder | F.element_at(parts, -1).rlike(r"(?i)^redaction-report.*[.]md$")


# duplicates
def duplicate_groups(items: DataFrame, item: str, content: str, algorithm: str = "md5") -> DataFrame:
    """hash, n and size of every content that occurs more than once. Every content is hashed where it lies, and what is
    shuffled is the hash and the size, never the content."""
    size = F.octet_length(content).cast("long")
    hashed = items.where(F.col(content).isNotNull()).select(size.alias("size"), _digest(content, algorithm).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("n"), F.min("size").alias("size")).where("n > 1")


def _digest(content: str, algorithm: str) -> Column:
    return F.md5(content) if algorithm == "md5" else F.sha2(content, 256)


def duplicate_candidates(items: DataFrame, item: str, content: str) -> DataFrame:
    """The numbers (or paths) of the items whose size another item has: what needs reading when sizes are known without
    it. Items and sizes are shuffled, never contents."""
    sized = items.where(F.col(content).isNotNull()).select(F.col(item).alias("item"), F.octet_length(content).alias("size"))
    twice = sized.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    return sized.join(twice, "size", "left_semi").select("item", "size")


def duplicate_members(items: DataFrame, item: str, content: str, age: str, algorithm: str = "md5") -> DataFrame:
    """hash, item and whether it is the newest or the oldest of its group, by age and then item."""
    h = items.where(F.col(content).isNotNull()).select(F.col(item).alias("item"), F.col(age).alias("age"), _digest(content, algorithm).alias("hash"))
    ends = h.groupBy("hash").agg(F.count("*").alias("n"), F.max(F.struct("age", "item")).alias("last"), F.min(F.struct("age", "item")).alias("first")).where("n > 1")
    return h.join(ends, "hash").select("hash", "item", (F.struct("age", "item") == F.col("last")).alias("is_newest"), (F.struct("age", "item") == F.col("first")).alias("is_oldest"))


def duplicate_report(files: DataFrame, algorithm: str = "md5") -> DataFrame:
    """hash, count, size_bytes, newest and all_files (by time, then path) from (path, size, ts, time_type, content)."""
    digest = _digest("content", algorithm)
    record = F.struct("path", "size", "ts", "time_type")
    rows = files.where("content is not null").select(digest.alias("hash"), record.alias("f"))
    groups = rows.groupBy("hash").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct(F.col("f.ts").alias("ts"), F.col("f.path").alias("path"), "f"))).alias("x")).where("count > 1")
    files_ = F.transform("x", lambda x: x["f"])
    return groups.select("hash", "count", F.get(files_, F.lit(0))["size"].alias("size_bytes"), F.element_at(files_, -1).alias("newest"), files_.alias("all_files"))


# folders
def ancestors(path: Column | str) -> Column:
    """All folders above a path, the top one first."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    ups = F.sequence(F.lit(1), F.size(parts) - 1)
    return F.when(F.size(parts) > 1, F.transform(ups, lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def skipped(parts: Column, skip: tuple[str, ...] = SKIPPED_DIRS) -> Column:
    return F.exists(parts, lambda p: p.isin(*skip) | p.startswith("."))


def empty_folders(folders: DataFrame, files: DataFrame, skip: tuple[str, ...] = SKIPPED_DIRS) -> DataFrame:
    """Folders without a file anywhere below them. Skipped and hidden folders don't count, nor do files in them;
    hidden files do. One explode of the files' ancestors instead of a walk below each folder."""
    kept = folders.where(~skipped(F.split("path", "/"), skip)).select("path").distinct()
    parts = F.split("path", "/")
    full = files.where(~skipped(F.slice(parts, 1, F.size(parts) - 1), skip)).select(F.explode(ancestors("path")).alias("path")).distinct()
    return kept.join(full, "path", "left_anti")


def empty_folder_counts(folders: DataFrame, empty: DataFrame) -> DataFrame:
    """One row: n_folders looked at, n_empty, and n_top, the empty ones whose parent is not empty itself."""
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    top = empty.select(parent.alias("path")).join(empty.select("path"), "path", "left_anti").agg(F.count("*").alias("n_top"))
    return folders.select("path").distinct().agg(F.count("*").alias("n_folders")).crossJoin(empty.agg(F.count("*").alias("n_empty"))).crossJoin(top)


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.lower(suffix("path")).alias("ext")).agg(F.count("*").alias("n"))


def session_logs(files: DataFrame) -> DataFrame:
    name = F.lower(file_name("path"))
    return files.where(name.endswith(".md") & (name.contains("scratchpad") | name.contains("session-log")))


def transcript_stems(files: DataFrame) -> DataFrame:
    """Stems of the .jsonl files at the top level, the history left out."""
    top = files.where(~F.col("path").contains("/") & F.col("path").endswith(".jsonl") & (F.col("path") != "history.jsonl"))
    return top.select(stem("path").alias("stem"))
