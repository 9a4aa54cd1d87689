"""Invariants of a finished copy: baseline tables against the state after, and the verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions.text import file_name, is_json

SHOWN = 20


def forbidden(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    base = file_name(path)
    return (
        path.contains("/subagents/") | path.startswith("subagents/") | (base == "audit.jsonl")
        | (base.startswith("agent-") & base.endswith(".jsonl")) | F.lower(base).contains("credentials")
    )


def wellformed(content: Column | str) -> Column:
    """Has the text a line that isn't blank, and is the first such line JSON?"""
    content = F.regexp_replace(F.col(content) if isinstance(content, str) else content, "^﻿", "")
    first = F.get(F.filter(F.split(content, "\n"), lambda x: x.rlike(r"(?U)\S")), F.lit(0))
    return is_json(first)


def added(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.select("item").distinct().join(before.select("item"), "item", "left_anti")


def _result(offenders: DataFrame, name: str) -> DataFrame:
    """id, status, n and up to SHOWN offenders in order. The list is cut in a top-n, never collected whole."""
    top = offenders.orderBy("item").limit(SHOWN).agg(F.array_sort(F.collect_list("item")).alias("items"))
    return offenders.agg(F.count("*").alias("n")).crossJoin(top).select(F.lit(name).alias("id"), F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status"), "n", "items")


def i1_nothing_lost(before: DataFrame, after: DataFrame) -> DataFrame:
    return _result(before.join(after.select("item"), "item", "left_anti").select("item"), "I1")


def i2_count_agrees(new: DataFrame, summary: DataFrame) -> DataFrame:
    """The number of new transcripts against what the copier said: FAIL without a summary, SKIPPED for a dry run."""
    n = new.agg(F.count("*").alias("n"))
    s = summary.select("s.transcripts_copied", "s.dry_run") if "s" in summary.columns else summary.select("transcripts_copied", "dry_run")
    status = F.when(F.col("dry_run").isNull() & F.col("transcripts_copied").isNull(), "FAIL").when(F.coalesce("dry_run", F.lit(False)), "SKIPPED").when(F.col("n") == F.col("transcripts_copied"), "PASS").otherwise("FAIL")
    note = F.when(F.col("transcripts_copied").isNull(), "no summary").when(F.col("n") > F.col("transcripts_copied"), "more than reported").when(F.col("n") < F.col("transcripts_copied"), "fewer than reported").otherwise("")
    return n.join(s, F.lit(True), "left").select(F.lit("I2").alias("id"), status.alias("status"), "n", F.array(note).alias("items"))


def i3_wellformed(files: DataFrame) -> DataFrame:
    """files: item and content of the new transcripts."""
    return _result(files.where(~wellformed("content")).select("item"), "I3")


def i4_nothing_forbidden(new_paths: DataFrame) -> DataFrame:
    return _result(new_paths.where(forbidden("item")).select("item"), "I4")


def i5_same(before: DataFrame, after: DataFrame, name: str = "I5") -> DataFrame:
    """One-row frames with a hash, null for an absent file: equal, both absent included."""
    same = before.select(F.col("hash").alias("a")).join(after.select(F.col("hash").alias("b")), F.lit(True), "full_outer")
    return same.select(F.lit(name).alias("id"), F.when(F.col("a").eqNullSafe(F.col("b")), "PASS").otherwise("FAIL").alias("status"), F.lit(0).cast("long").alias("n"), F.array(F.coalesce("b", F.lit("(absent)"))).alias("items"))


def i6_sources_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Frames of (section, item): what differs in either direction."""
    a, b = before.select("section", "item").distinct(), after.select("section", "item").distinct()
    odd = a.join(b, ["section", "item"], "left_anti").unionByName(b.join(a, ["section", "item"], "left_anti"))
    return _result(odd.select(F.concat_ws("/", "section", "item").alias("item")), "I6")


def all_results(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def last_summary(log: DataFrame) -> DataFrame:
    """s: the last well-formed summary of (lineno, line) rows; null if there is none."""
    schema = "transcripts_copied long, transcripts_skipped long, tool_results_copied long, memory_copied long, errors long, dry_run boolean"
    json = F.regexp_extract("line", r"^\s*MACHINE_SUMMARY\s+(\{.*\})\s*$", 1)
    rows = log.select("lineno", json.alias("json")).where(is_json("json"))
    return rows.agg(F.from_json(F.max_by("json", "lineno"), schema).alias("s"))


def verdict(results: DataFrame, dry_run: Column | bool = False, errors: Column | int = 0) -> DataFrame:
    """verdict and exit_code: a failure or copy error is FAIL before all else, then a dry run PARTIAL PASS, then a
    skipped invariant FAIL."""
    dry = F.lit(dry_run) if isinstance(dry_run, bool) else dry_run
    bad = F.lit(errors) if isinstance(errors, int) else errors
    counts = results.agg(*(F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s) for s in ("FAIL", "SKIPPED")))
    word = F.when((F.col("FAIL") > 0) | (bad > 0), "FAIL").when(dry, "PARTIAL PASS").when(F.col("SKIPPED") > 0, "FAIL").otherwise("PASS")
    return counts.select(word.alias("verdict")).withColumn("exit_code", F.when(F.col("verdict") == "PASS", 0).when(F.col("verdict") == "PARTIAL PASS", 1).otherwise(2))


def baseline(snapshot: DataFrame, path: str) -> None:
    """Keep (section, item) rows; an existing baseline is never overwritten."""
    snapshot.write.mode("errorifexists").parquet(path)


