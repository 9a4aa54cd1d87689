"""Session logs: registry, sidecars, classification of transcripts, copy plans and snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions.text import file_name

SPACE_KEYS = "spaceId space_id projectId project_id space project".split()
NESTED_KEYS = "id spaceId uuid".split()
TITLE_KEYS = "title name summary subject".split()


def _string(json: Column, path: str) -> Column:
    """A value that is present and a JSON string; numbers and objects don't count."""
    v = F.try_parse_json(json)
    got = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(v, path, "string"))


def parse_registry(files: DataFrame, json: str = "json") -> DataFrame:
    """space_id and name from any of three shapes: a list, {"spaces": [...]}, or an object by id."""
    v = F.try_parse_json(F.regexp_replace(json, "^﻿", ""))
    shape = F.schema_of_variant(v)
    inner = F.try_variant_get(v, "$.spaces", "variant")
    rows = files.select(v.alias("v"), shape.alias("shape"), inner.alias("inner"))
    listed = rows.select(F.when(F.col("shape").startswith("ARRAY"), F.col("v")).when(F.schema_of_variant("inner").startswith("ARRAY"), F.col("inner")).alias("list"), "v", "shape", "inner")
    from_list = _explode(listed.where("list is not null"), "list")
    from_list = from_list.select(F.coalesce(_field("value", "id"), _field("value", "spaceId"), F.concat(F.lit("_idx"), F.col("pos"))).alias("space_id"), F.coalesce(_field("value", "name"), _field("value", "title")).alias("name"))
    by_id = _explode(listed.where("list is null and shape like 'OBJECT%'"), "v")
    by_id = by_id.select(F.col("key").alias("space_id"), F.coalesce(_field("value", "name"), _field("value", "title")).alias("name"))
    return from_list.unionByName(by_id)


def _field(variant: str, key: str) -> Column:
    got = F.try_variant_get(F.col(variant), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(F.col(variant), f"$.{key}", "string"))


def _explode(rows: DataFrame, column: str) -> DataFrame:
    # the only generator over variants is a table function
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(column).outer())).select("pos", "key", "value")


def sidecars(files: DataFrame) -> DataFrame:
    """session_id, space_id and title from (path, json): the first of each key's spellings that is a string."""
    session = F.regexp_replace(file_name("path"), r"\.json$", "")
    return files.select(
        session.alias("session_id"),
        F.coalesce(*(_string(F.col("json"), p) for k in SPACE_KEYS for p in (f"$.{k}", *(f"$.{k}.{n}" for n in NESTED_KEYS)))).alias("space_id"),
        F.coalesce(*(_string(F.col("json"), f"$.{k}") for k in TITLE_KEYS)).alias("title"),
    )


def classify(path: Column | str) -> Column:
    """transcript, or why a .jsonl is none: subagent, audit, non_project, credentials, agent; the first that holds."""
    path = F.col(path) if isinstance(path, str) else path
    base = file_name(path)
    return (
        F.when(path.contains("/subagents/"), "subagent")
        .when(path.endswith("/audit.jsonl"), "audit")
        .when(~path.contains("/.claude/projects/"), "non_project")
        .when(F.lower(base).contains("credentials"), "credentials")
        .when(base.startswith("agent-"), "agent")
        .otherwise("transcript")
    )


def classified(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".jsonl")).select("*", classify("path").alias("class"))


def class_totals(files: DataFrame) -> DataFrame:
    """class and n in one pass."""
    return classified(files).groupBy("class").agg(F.count("*").alias("n"))


def space_counts(sessions: DataFrame, spaces: DataFrame) -> DataFrame:
    """space_id, name and n_sessions; unregistered ids are labelled, sessions without one are '(unassigned)'."""
    n = sessions.groupBy("space_id").agg(F.count("*").alias("n_sessions"))
    unknown = F.concat(F.lit("(unknown: "), F.substring("space_id", 1, 8), F.lit("...)"))
    name = F.when(F.col("space_id").isNull(), "(unassigned)").otherwise(F.coalesce("name", unknown))
    return n.join(spaces, "space_id", "left").select("space_id", name.alias("name"), "n_sessions")


def orphans(session_dirs: DataFrame, sessions: DataFrame) -> DataFrame:
    return session_dirs.join(sessions, "session_id", "left_anti")


def find_space(spaces: DataFrame, wanted: str) -> str:
    """The id of a space by id or unique name, case ignored."""
    rows = spaces.where((F.lower("space_id") == wanted.lower()) | (F.lower(F.trim("name")) == wanted.strip().lower())).limit(21).collect()
    exact = [r["space_id"] for r in rows if r["space_id"].lower() == wanted.lower()]
    ids = exact or sorted({r["space_id"] for r in rows})
    if len(ids) != 1:
        raise ValueError(f"no space is called {wanted!r}" if not ids else f"{wanted!r} names {len(ids)} spaces")
    return ids[0]


def in_space(sessions: DataFrame, space_id: str) -> DataFrame:
    return sessions.where(F.col("space_id") == space_id)


def tool_results(transcripts: DataFrame, files: DataFrame) -> DataFrame:
    """path and transcript of the files in <folder>/<stem>/tool-results/ of a transcript."""
    t = transcripts.select(F.col("path").alias("transcript"), F.regexp_replace("path", r"\.jsonl$", "/tool-results").alias("prefix"))
    f = files.where(F.col("path").contains("/tool-results/")).select("path", F.regexp_extract("path", r"^(.*?/tool-results)/", 1).alias("prefix"))
    return f.join(t, "prefix").select("path", "transcript")


def copy_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """path, size and action: skip what the target has, recopy what it has empty, never copy the memory index."""
    t = target.groupBy("path").agg(F.max("size").alias("t_size"))
    action = F.when(file_name("path") == "MEMORY.md", "never").when(F.col("t_size").isNull(), "copy").when(F.col("t_size") == 0, "recopy").otherwise("skip")
    return source.join(t, "path", "left").select("path", "size", action.alias("action"))


def snapshot(files: DataFrame) -> DataFrame:
    """section and item of a target folder's top level: transcripts, folders, memory notes, other files. Hidden names,
    the history and the memory folder itself are left out."""
    top = ~F.col("path").contains("/")
    hidden = F.col("path").startswith(".")
    note = F.col("path").rlike(r"^memory/[^/]+\.md$")
    section = (
        F.when(note, "memory")
        .when(~top | hidden | (F.col("path") == "history.jsonl"), F.lit(None))
        .when(F.col("is_dir"), F.when(F.col("path") != "memory", "subdir"))
        .when(F.col("path").endswith(".jsonl"), "jsonl")
        .otherwise("other")
    )
    item = F.when(section == "jsonl", F.regexp_replace("path", r"\.jsonl$", "")).when(note, file_name("path")).otherwise(F.col("path"))
    return files.select(section.alias("section"), item.alias("item")).where("section is not null").distinct()


def snapshot_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("section").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("item")).alias("items"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """section, item and status (added or removed)."""
    a, b = (x.select("section", "item", F.lit(True).alias(n)) for x, n in ((before, "was"), (after, "is")))
    both = a.join(b, ["section", "item"], "full_outer")
    return both.where("was is null or is is null").select("section", "item", F.when(F.col("was").isNull(), "added").otherwise("removed").alias("status"))


def machine_summary(counts: DataFrame) -> DataFrame:
    """One line of one row's six figures."""
    names = ("transcripts_copied", "transcripts_skipped", "tool_results_copied", "memory_copied", "errors", "dry_run")
    return counts.select(F.concat(F.lit("MACHINE_SUMMARY "), F.to_json(F.struct(*names))).alias("line"))
