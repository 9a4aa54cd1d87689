"""The redaction report: tallies as tables, and their text on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.functions.text import shown
from siftlane.operators.recognizers import REGEX_ENTITIES, engine


def entity_block(tally: DataFrame) -> DataFrame:
    """entity, engine, n_unique and hits of every type that is not a keyword."""
    t = tally.where(~F.col("entity").startswith("KW_"))
    return t.groupBy("entity").agg(F.count("*").alias("n_unique"), F.sum("count").alias("hits")).withColumn("engine", engine("entity"))


def entity_rows(tally: DataFrame) -> DataFrame:
    """entity, shown text and count; texts that look alike stay apart."""
    return tally.where(~F.col("entity").startswith("KW_")).select("entity", shown("matched_text").alias("shown"), "count")


def keyword_tally(tally: DataFrame, table: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """idx, find, replace and count of the keywords that occur: KW_i of the tally, and counts by find."""
    t = tally.where(F.col("entity").startswith("KW_")).groupBy(F.regexp_extract("entity", r"^KW_(\d+)", 1).cast("int").alias("idx")).agg(F.sum("count").alias("c"))
    rows = table.join(t, "idx", "left")
    if extra is not None:
        rows = rows.join(extra.select("find", F.col("count").alias("x")), "find", "left")
        return rows.select("idx", "find", "replace", (F.coalesce("c", F.lit(0)) + F.coalesce("x", F.lit(0))).alias("count")).where("count > 0")
    return rows.select("idx", "find", "replace", F.col("c").alias("count")).where("count > 0")


def blackout(keywords: DataFrame) -> DataFrame:
    return keywords.where("replace is null").groupBy("find").agg(F.sum("count").alias("count"))


def replaced(keywords: DataFrame) -> DataFrame:
    """pseudonym, aliases (distinct finds) and hits."""
    return keywords.where("replace is not null").groupBy(F.col("replace").alias("pseudonym")).agg(F.countDistinct("find").alias("aliases"), F.sum("count").alias("hits"))


def grand_total(tally: DataFrame, keywords: DataFrame) -> DataFrame:
    parts = tally.where(~F.col("entity").startswith("KW_")).select("count").unionByName(keywords.select("count"))
    return parts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("grand_total"))


def grand_total_of(tally: DataFrame, table: DataFrame) -> DataFrame:
    """grand_total of a tally and its own keywords, those of table. The tally is read once: two branches would each search all texts,
    as Spark moves their filters below it."""
    own = table.select(F.concat(F.lit("KW_"), F.col("idx").cast("string")).alias("entity"), F.lit(True).alias("known"))
    rows = tally.join(F.broadcast(own), "entity", "left").where(~F.col("entity").startswith("KW_") | F.col("known"))
    return rows.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("grand_total"))


def engaged(entities: list[str], models: bool, keywords: list) -> dict[str, bool]:
    return {
        "pattern": any(e in REGEX_ENTITIES for e in entities),
        "model": models,
        "blackout": any(k.replace is None for k in keywords),
        "replaced": any(k.replace is not None for k in keywords),
    }


def build(tally: DataFrame, keywords: DataFrame, replacement: str) -> dict:
    """All tables of the report collected: their size follows what was found, not the input."""
    blocks: dict[str, list] = {"regex": [], "NER": []}
    rows: dict[str, list] = {}
    for r in entity_rows(tally).orderBy("entity", F.desc("count"), "shown").collect():
        rows.setdefault(r["entity"], []).append((r["shown"], r["count"]))
    for b in entity_block(tally).orderBy("entity").collect():
        new = "[URL]" if b["entity"] == "URL" else replacement
        blocks[b["engine"]].append((b["entity"], b["n_unique"], b["hits"], new, rows[b["entity"]]))
    black = [(r["find"], r["count"]) for r in blackout(keywords).orderBy(F.desc("count"), "find").collect()]
    groups = []
    for g in replaced(keywords).orderBy("pseudonym").collect():
        own = keywords.where(F.col("replace") == g["pseudonym"]).groupBy("find").agg(F.sum("count").alias("count"))
        groups.append((g["pseudonym"], g["aliases"], g["hits"], [(r["find"], r["count"]) for r in own.orderBy(F.desc("count"), "find").collect()]))
    total = grand_total(tally, keywords).first()["grand_total"]
    return {"pattern": blocks["regex"], "model": blocks["NER"], "blackout": black, "replaced": groups, "replacement": replacement, "grand_total": total}


_SECTIONS = (
    ("pattern", "PATTERN MATCHES  (regex — deterministic)", "no pattern types were asked for", "patterns ran and found nothing"),
    ("model", "MODEL ENTITIES  (NER — probabilistic)", "no model types were asked for", "the model ran and found nothing"),
    ("blackout", "CUSTOM KEYWORDS — blacked out", "there are no plain keywords", "plain keywords ran and found nothing"),
    ("replaced", "CUSTOM KEYWORDS — replaced", "there are no keywords with pseudonyms", "they ran and found nothing"),
)


def _items(rows: list) -> list[str]:
    return [f"    {text:<28} ×{n}" for text, n in rows]


def _section(report: dict, key: str) -> list[str]:
    found = report[key]
    if key in ("pattern", "model"):
        return [x for e, u, h, new, rows in found for x in (f"{f'{e:<14} ({u} unique · {h} hits)':<48} → {new}", *_items(rows))]
    if key == "replaced":
        return [x for p, a, h, rows in found for x in (f"{p:<14} ({a} {'alias' if a == 1 else 'aliases'} · {h} hits)", *_items(rows))]
    if not found:
        return []
    head = f"{'':<14} ({len(found)} unique · {sum(n for _, n in found)} hits)"
    return [f"{head:<48} → {report['replacement']}", *_items(found)]


def render(report: dict, flags: dict[str, bool], title: str, scanned: int, matched: int, extensions: list[str] | None = None, output: str | None = None, names: dict | None = None) -> str:
    """The report as text. A preview and a real run differ in title and output line alone."""
    bar, thin = "═" * 68, "─" * 48
    out = [bar, f"  {title}", *([f"  Output at: {output}"] if output is not None else [])]
    out += [f"  Extensions scanned: {', '.join(extensions or ['all'])}        {scanned} files scanned · {matched} with matches", bar, ""]
    for key, head, absent, empty in _SECTIONS:
        body = _section(report, key) or [f"    none   ← {empty}" if flags.get(key, True) else f"    N/A    ← {absent}"]
        out += [head, thin, *body, ""]
    if names is not None:
        out += ["FILENAME REDACTIONS", thin]
        out += [f"    {label}: {names.get(k, 0)}" for label, k in (("Files renamed      ", "files_renamed"), ("Dir parts renamed  ", "dirs_renamed"), ("Collisions resolved", "collisions"), ("Plain-keyword leaks", "flagged_files"))]
        out += [f"      {old}  → {new}" for old, new in names.get("renames", [])] + [f"      {n}  ← {', '.join(t)}" for n, t in names.get("flags", [])] + [""]
    return "\n".join([*out, "─" * 50, f"  GRAND TOTAL: {report['grand_total']} redactions across {matched} files", bar])


def render_markdown(report: dict, flags: dict[str, bool], heading: str, meta: list, stats: list[tuple[str, object]], **how) -> str:
    """The report as a Markdown document: banner, meta, summary table, and the whole text report."""
    rows = [("Files scanned · with matches", f"{how['scanned']} · {how['matched']}"), *stats]
    rows += [(f"{word} — {e}", f"{u} unique · {h} hits") for word, key in (("PATTERN", "pattern"), ("MODEL", "model")) for e, u, h, _, _ in report[key]]
    rows += [
        ("Keywords — blacked out", f"{len(report['blackout'])} unique · {sum(n for _, n in report['blackout'])} hits"),
        ("Keywords — replaced", f"{len(report['replaced'])} pseudonyms · {sum(g[2] for g in report['replaced'])} hits"),
        ("GRAND TOTAL", report["grand_total"]),
    ]
    bullets = ["- " + ("**{}:** {}".format(*m) if isinstance(m, tuple) else m) for m in meta]
    banner = ["> **SENSITIVE: this report quotes the matched texts.**", "> Keep it local and outside the output folder."]
    return "\n".join([f"# {heading}", "", *banner, "", *([*bullets, ""] if bullets else []), "## Summary", "", "| What | How much |", "| :-- | :-- |", *(f"| {a} | {b} |" for a, b in rows), "", "## Itemized", "", "```", render(report, flags, **how), "```", ""])


def render_scan(rows: list) -> str:
    """Collected scan() rows by type, most frequent first."""
    if not rows:
        return "  No candidate entities found."
    out = ["  Candidate entities (real data: keep this output local):"]
    for entity in sorted({r["entity"] for r in rows}):
        mine = sorted((r for r in rows if r["entity"] == entity), key=lambda r: (-r["count"], r["matched_text"]))
        width = max(len(r["matched_text"]) for r in mine)
        out += [f"  {entity}  ({len(mine)} unique)", *(f"    {r['matched_text']:<{width}}  ... {r['count']}" for r in mine)]
    return "\n".join(out)
