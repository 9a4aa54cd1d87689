"""Command line over a folder: find, duplicates, empty, search, scan, redact and throttle (names file into the
configuration, then redact). The exit code of a redaction is the number of files that failed."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.functions.text import decode
from siftlane.operators import filenames, images, inventory, keywords, report, search, structured
from siftlane.operators.documents import csv_cells, csv_text
from siftlane.operators.recognizers import REGEX_ENTITIES, gazetteer
from siftlane.operators.redact import Redactor, scan, tally
from siftlane.sources import config, readers, sinks
from siftlane.sources.tree import duplicates, tree


def _redactor(cfg: dict, own: list[keywords.Keyword]) -> Redactor:
    """The configuration's redactor; a list of names (names: [...]) stands in for a model of persons."""
    models = (gazetteer("PERSON", cfg["names"]),) if cfg.get("names") and not cfg["regex_only"] else ()
    return Redactor(tuple(cfg["entities"]), tuple(own), cfg["replacement"], models, regex_only=bool(cfg["regex_only"]))


class Files:
    """The files of each kind, routed by the configuration."""

    def __init__(self, files: DataFrame, cfg: dict):
        kind = inventory.route("path", cfg["include_extensions"], list(cfg["skip_extensions"]), bool(cfg["copy_unhandled"]))
        if cfg["include_extensions"]:  # what the list leaves out is unhandled, as a type without a handler is
            skip = F.lower(inventory.suffix("path")).isin(*cfg["skip_extensions"]) if cfg["skip_extensions"] else F.lit(False)
            kind = F.when((kind == "skip") & ~skip, "copied" if cfg["copy_unhandled"] else "uncopied").otherwise(kind)
        self.rows = files.where(~F.col("is_dir") & ~inventory.own_output("path", cfg["output_dir"])).withColumn("kind", kind)
        self.stats = {r["kind"]: r["count"] for r in self.rows.groupBy("kind").count().collect()}
        self.nested = bool(cfg["decode_nested_json"])
        content = readers.read(self.rows.where(F.col("kind").isin("md", "txt", "html", "json", "csv")), "").withColumn("kind", kind)
        self.unread = content.where("content is null").select("path")
        self.content = content.where("content is not null")

    def of(self, *kinds: str, bom: bool = False) -> DataFrame:
        return self.content.where(F.col("kind").isin(*kinds)).select("path", decode("content", bom=bom).alias("text"))

    @property
    def csv(self) -> DataFrame:
        """Bytes that aren't UTF-8 make a file fail, as they must not become other characters in a table."""
        ok = self.content.where((F.col("kind") == "csv") & F.is_valid_utf8(F.col("content").cast("string")))
        return ok.select("path", csv_cells(decode("content", bom=True)).alias("cells"))

    def failed(self) -> list[str]:
        """Paths of what can't be read, is no UTF-8 table or no JSON."""
        bad_csv = self.content.where((F.col("kind") == "csv") & ~F.is_valid_utf8(F.col("content").cast("string"))).select("path")
        bad_json = self.of("json", bom=True).where(~structured.parses("text")).select("path")
        return sorted(r["path"] for r in self.unread.unionByName(bad_csv).unionByName(bad_json).collect())

    def leaves(self) -> DataFrame:
        """Every text of every format."""
        return structured.leaf_rows(self.of("md", "txt"), self.of("html"), self.of("json", bom=True), self.csv, self.nested)

    def redacted(self, redactor: Redactor) -> DataFrame:
        """path and redacted of every handled file, null where it doesn't parse."""
        out = redactor.apply(self.of("md", "txt")).select("path", "redacted")
        out = out.unionByName(structured.redact_html(self.of("html"), redactor).select("path", "redacted"))
        out = out.unionByName(structured.redact_json(self.of("json", bom=True), redactor, self.nested).select("path", "redacted"))
        return out.unionByName(structured.redact_csv(self.csv, redactor).select("path", csv_text("cells").alias("redacted")))


def _redact(spark: SparkSession, folder: str, cfg: dict, preview: bool, report_to: str | bool | None) -> int:
    own = keywords.normalize(cfg["custom_keywords"])
    try:
        redactor = _redactor(cfg, own)
        files = Files(tree(spark, folder), cfg)
        for kind, registry in (("pdf", images.PDF), ("img", images.OCR)):
            if files.stats.get(kind) and not registry:
                images.backend(kind.upper(), registry)
    except RuntimeError as e:
        print(f"{e}; nothing was written", file=sys.stderr)
        return 1
    stamp = datetime.now().strftime("%Y%m%d-%H%M%S")
    stamped = lambda name: f"{name}-{stamp}" if cfg["timestamp_outputs"] else name
    # one absolute place, the same for every executor
    output = str(Path(folder).resolve() / stamped(cfg["output_dir"]))
    done = files.redacted(redactor)
    errors = files.failed()
    lost = spark.createDataFrame([(p,) for p in errors], "path string")
    seen = redactor.apply(files.leaves().join(lost, "path", "left_anti"))
    # the report lists every distinct match, so that the tally comes to the driver once and is not computed again
    shape = "entity string, matched_text string, count long"
    found = spark.createDataFrame(tally(seen).collect() if redactor.mode != "keyword" else [], shape)
    counted = spark.createDataFrame(keywords.counts(seen, "text", own).collect(), "find string, count long") if redactor.mode == "keyword" and own else None
    built = report.build(found, report.keyword_tally(found, keywords.table(spark, own), counted), cfg["replacement"])
    out, copies, names = done.where("redacted is not null"), files.rows.where("kind = 'copied'").select("path"), None
    plan = None
    if cfg["redact_filenames"]:
        least = int(cfg["filename_min_match_len"])
        every = files.rows.where(~F.col("kind").isin("skip", "uncopied")).select("path").join(lost, "path", "left_anti")
        plan = filenames.resolve_collisions(filenames.rename(every, own, least))
        renames = [(r["path"], r["final"]) for r in plan.where("path <> final").orderBy("path").collect()]
        flagged = [(r["final"], r["terms"]) for r in filenames.flags(plan, own, least).orderBy("final").collect()]
        names = filenames.summary(plan, own, least).first().asDict() | {"renames": renames, "flags": flagged}
        out = out.join(plan.select("path", "final"), "path").select(F.col("final").alias("path"), "redacted")
    if not preview:
        Path(output).mkdir(parents=True, exist_ok=True)
        sinks.write_tree(out, output, text="redacted").count()
        if cfg["copy_unhandled"]:
            final = copies.withColumn("final", F.col("path")) if plan is None else copies.join(plan.select("path", "final"), "path")
            bad = sinks.copy_files(final.withColumn("action", F.lit("copy")), folder, output).where("error is not null").select("path").collect()
            errors += sorted(r["path"] for r in bad)
    by_file = seen.groupBy("path").agg(F.sum("n_redactions").alias("n"))
    matched = by_file.where("n > 0").count()
    scanned = sum(n for k, n in files.stats.items() if k in ("md", "txt", "html", "json", "csv")) - len(errors)
    flags = report.engaged(cfg["entities"], bool(redactor.models), own)
    how = {"title": "REDACTION PREVIEW" if preview else "REDACTION COMPLETE", "scanned": scanned, "matched": matched, "extensions": cfg["include_extensions"] or None, "output": None if preview else output, "names": names}
    print(report.render(built, flags, **how))
    for k in ("copied", "uncopied", "skip"):
        if files.stats.get(k):
            print(f"  {k}: {files.stats[k]}")
    for p in errors:
        print(f"  failed: {p}", file=sys.stderr)
    where = config.report_path(report_to, cfg["report"], str(Path(folder) / f"{stamped('redaction-report')}.md"))
    if where:
        rows = [(k, files.stats.get(k, 0)) for k in ("copied", "uncopied", "skip")] + [("failed", len(errors))]
        Path(where).write_text(report.render_markdown(built, flags, "Redaction report", [("Input", folder)], rows, **how), encoding="utf-8")
    return len(errors)


def _throttle(spark: SparkSession, folder: str, path: str | None, preview: bool, report_to: str | bool | None) -> int:
    """Names file into the configuration (kept as .bak, checked, moved into place), then the redaction. With preview the
    configuration is changed in memory alone. Nothing is written when the names file or the markers are wrong."""
    try:
        cfg = config.load(path)
        names = Path(cfg.get("names_file") or "names.md").expanduser()
        if path is None or not names.is_file():
            raise ValueError(f"{'a configuration' if path is None else names} is needed")
        lines = spark.createDataFrame(list(enumerate(names.read_text(encoding="utf-8").split("\n"), 1)), "lineno int, line string")
        twice = [r["find"] for r in keywords.duplicate_finds(lines).orderBy("find").collect()]
        if twice:
            raise ValueError(f"{names.name} has {', '.join(twice)} more than once")
        entries = keywords.yaml_entries(keywords.codes(lines).collect())
        cfg = config.load_text(config.splice(path, entries, write=not preview))
    except ValueError as e:
        print(f"{e}; nothing was changed", file=sys.stderr)
        return 1
    return _redact(spark, folder, cfg, preview, report_to)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siftlane", description=__doc__)
    p.add_argument("command", choices=["find", "duplicates", "empty", "search", "scan", "redact", "throttle"])
    p.add_argument("folder")
    p.add_argument("argument", nargs="?")
    p.add_argument("--config")
    p.add_argument("--include", help="extensions to process, with commas, in place of the configured ones")
    p.add_argument("--report", nargs="?", const=True, help="write the report as Markdown, beside the input or to a path")
    p.add_argument("--preview", help="print the report and write no output", action="store_true")
    a = p.parse_args(argv)
    if a.command in ("find", "search") and not a.argument:
        print(f"{a.command} needs an argument", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("siftlane").getOrCreate()
    if a.command == "throttle":
        return _throttle(spark, a.folder, a.config, a.preview, a.report)
    cfg = config.load(a.config)
    if a.include is not None:
        cfg["include_extensions"] = inventory.normalize_extensions(a.include.split(","))
    if a.command == "redact":
        return _redact(spark, a.folder, cfg, a.preview, a.report)
    files = tree(spark, a.folder)
    if a.command == "find":
        for r in inventory.find_by_extension(files, a.argument).orderBy(F.split("path", "/")).toLocalIterator():
            print(r["path"])
        return 0
    if a.command == "duplicates":
        for r in duplicates(files).orderBy("hash").toLocalIterator():
            print(r["hash"], r["count"], *r["paths"], sep="\n  ")
        return 0
    if a.command == "empty":
        rows = [r["path"] for r in inventory.empty_folders(files.where("is_dir"), files.where("not is_dir")).orderBy("path").collect()]
        print("\n".join(rows))
        return int(bool(rows))
    if a.command == "search":
        for r in search.search_lines(readers.text_files(inventory.session_logs(files)), "path", "text", a.argument).orderBy("path", "lineno").toLocalIterator():
            print(f"{r['path']}:{r['lineno']}: {r['line']}")
        return 0
    if not cfg.get("names"):  # a scan without a model lists what patterns and keywords find
        cfg["entities"] = [e for e in cfg["entities"] if e in REGEX_ENTITIES]
    print(report.render_scan(scan(Files(files, cfg).leaves(), _redactor(cfg, keywords.normalize(cfg["custom_keywords"]))).collect()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
