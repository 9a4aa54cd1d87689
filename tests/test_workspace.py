"""Trees, names, sessions, verification, sections and formats."""

from __future__ import annotations

import io
import json
import os
import subprocess
import sys
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftlane.operators import documents, filenames, images, inventory, search, sections, sessions, verify
from siftlane.operators.keywords import Keyword
from siftlane.operators.redact import Redactor
from siftlane.sources import config, readers, sinks
from siftlane.sources.tree import content, duplicates, tree
from siftlane.streaming import redact_stream, tally_stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for rel, body in {
        "a/f.md": "Ada a@b.org", "a/E.MD": "x", "a/.hid.md": "same", "_x/g.md": "same", "a/.git/h.md": "h", "b/c/d.txt": "d", "b/session-log.md": "one\ntwo TWO\nthree", "e/dir.md/k.json": '{"a": "Ada"}',
        "node_modules/z.md": "z", "p.csv": "Ada,1\r\n\"x,y\",Ada\r\n", "q.html": "<p>Ada</p>", "redacted/old.md": "Ada", "top.md": "samE",
    }.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body.encode())
    (root / "empty/deep").mkdir(parents=True)
    return str(root)


def paths(df, column="path"):
    return sorted(r[column] for r in df.collect())


def test_tree_has_hidden_names(spark, folder):
    files = tree(spark, folder)
    assert {"a/.hid.md", "_x/g.md", "a/.git/h.md"} <= set(paths(files.where("not is_dir")))
    assert "e/dir.md" in paths(inventory.find_by_extension(files, "md"))  # folders too
    assert "a/E.MD" not in paths(inventory.find_by_extension(files, ".md"))
    with pytest.raises(Exception, match="nowhere"):
        tree(spark, folder + "/nowhere").collect()


def test_duplicates_of_a_tree(spark, folder):
    got = duplicates(tree(spark, folder)).collect()
    assert {tuple(sorted(r["paths"])) for r in got} == {("_x/g.md", "a/.hid.md")}
    report = inventory.duplicate_report(tree(spark, folder).where("not is_dir").withColumn("content", content("abs_path")))
    r = report.first()
    assert r["count"] == 2 and r["size_bytes"] == 4 and r["newest"]["path"] in ("_x/g.md", "a/.hid.md") and len(r["all_files"]) == 2


def test_empty_folders(spark, folder):
    files = tree(spark, folder)
    assert paths(inventory.empty_folders(files.where("is_dir"), files.where("not is_dir"))) == ["empty", "empty/deep"]


def test_routes(spark):
    df = spark.createDataFrame([("a.MD",), ("b.py",), ("c.csv",), ("d.HTML",), ("e",)], "path string")
    got = {r["path"]: r["k"] for r in df.select("path", inventory.route("path", skip=[".csv"]).alias("k")).collect()}
    assert got == {"a.MD": "md", "b.py": "uncopied", "c.csv": "skip", "d.HTML": "html", "e": "uncopied"}
    got = {r["path"]: r["k"] for r in df.select("path", inventory.route("path", include=["md", " .PY "], copy_unhandled=True).alias("k")).collect()}
    assert got == {"a.MD": "md", "b.py": "copied", "c.csv": "skip", "d.HTML": "skip", "e": "skip"}
    own = spark.createDataFrame([("redacted/a.md",), ("x/redacted-1/a.md",), ("redacted.md",), ("x/Redaction-Report-2.md",), ("a.md",)], "path string")
    assert paths(own.where(inventory.own_output("path", "redacted"))) == ["redacted/a.md", "x/Redaction-Report-2.md", "x/redacted-1/a.md"]


def test_readers_search_and_sinks(spark, folder, tmp_path):
    files = tree(spark, folder)
    logs = readers.text_files(inventory.session_logs(files))
    assert [(r["lineno"], r["line"]) for r in search.search_lines(logs, "path", "text", "two").collect()] == [(2, "two TWO")]
    assert tuple(search.search_totals(logs, "path", "text", "T").first()) == (2, 1)
    assert readers.csv_files(files).first()["cells"] == [["Ada", "1"], ["x,y", "Ada"]]
    assert json.loads(readers.json_files(files).first()["text"]) == {"a": "Ada"}
    done = sinks.write_tree(readers.text_files(files).where("path like 'a/%'"), str(tmp_path)).collect()
    assert (tmp_path / "a/f.md").read_text() == "Ada a@b.org" and sum(r["bytes"] for r in done) > 0
    with pytest.raises(Exception, match="leaves"):
        sinks.write_tree(spark.createDataFrame([("../x", "y")], "path string, text string"), str(tmp_path)).collect()
    plan = spark.createDataFrame([("a/f.md", "copy"), ("a/none", "copy"), ("a/E.MD", "skip")], "path string, action string")
    errors = {r["path"]: r["error"] for r in sinks.copy_files(plan, folder, str(tmp_path / "copy")).collect()}
    assert errors["a/f.md"] is None and errors["a/none"] and (tmp_path / "copy/a/f.md").exists() and not (tmp_path / "copy/a/E.MD").exists()


KEYS = [Keyword("Acme", "[ORG-1]"), Keyword("Secret"), Keyword("ab", "x")]


def test_renames(spark):
    rel = ["Acme notes.md", "acme-notes.md", "ACME-notes.md", "x/acme/acme.tar.gz", "Secret.md", "cab.md", ".acme"]
    plan = filenames.resolve_collisions(filenames.rename(spark.createDataFrame([(p,) for p in rel], "path string"), KEYS))
    got = {r["path"]: (r["final"], r["hits"]) for r in plan.collect()}
    assert got["ACME-notes.md"] == ("ORG-1-notes.md", 1) and got["acme-notes.md"] == ("ORG-1-notes__2.md", 1)
    assert got["x/acme/acme.tar.gz"] == ("x/ORG-1/ORG-1.tar.gz", 2) and got["cab.md"] == ("cab.md", 0) and got[".acme"] == (".ORG-1", 1)
    assert [(r["final"], r["terms"]) for r in filenames.flags(plan, KEYS).collect()] == [("Secret.md", ["Secret"])]
    assert filenames.summary(plan, KEYS).first().asDict() == {"files_renamed": 5, "collisions": 1, "flagged_files": 1, "dirs_renamed": 1}
    assert "Secret.md\tSecret" in filenames.render_flags(filenames.flags(plan, KEYS).collect())
    assert filenames.split_keywords(KEYS)[2] == ["ab"]


def test_numbered_names_never_clash(spark):
    df = spark.createDataFrame([("a.md", "A.md", 1), ("b.md", "A.md", 1), ("c.md", "A__2.md", 1), ("z/a.md", "z/A.md", 1)], "path string, renamed string, hits long")
    got = {r["path"]: r["final"] for r in filenames.resolve_collisions(df).collect()}
    assert got["a.md"] == "A.md" and got["z/a.md"] == "z/A.md" and len(set(got.values())) == 4


def test_sessions(spark):
    shapes = ['[{"id": "u1", "name": "One"}, {"spaceId": "u2"}, {"name": "x"}]', '{"spaces": [{"id": "u3", "name": "Three"}]}', '{"u4": {"name": "Four"}}', "﻿[]", "bad"]
    reg = sessions.parse_registry(spark.createDataFrame([(s,) for s in shapes], "json string"))
    assert {tuple(r) for r in reg.collect()} == {("u1", "One"), ("u2", None), ("_idx2", "x"), ("u3", "Three"), ("u4", "Four")}
    side = spark.createDataFrame([("w/local_1.json", '{"space": {"id": "u1"}, "title": "T"}'), ("local_2.json", '{"spaceId": 5}'), ("local_3.json", '{"space_id": ""}')], "path string, json string")
    assert {r["session_id"]: (r["space_id"], r["title"]) for r in sessions.sidecars(side).collect()} == {"local_1": ("u1", "T"), "local_2": (None, None), "local_3": ("", None)}
    base = "s/.claude/projects/p/"
    want = {
        "s/.claude/projects/subagents/a.jsonl": "subagent", base + "audit.jsonl": "audit", "s/x/t.jsonl": "non_project", base + "my-Credentials.jsonl": "credentials",
        base + "agent-1.jsonl": "agent", base + "t.jsonl": "transcript", "x/subagents/agent-2.jsonl": "subagent",
    }
    df = spark.createDataFrame([(p,) for p in (*want, "note.md")], "path string")
    assert {r["path"]: r["class"] for r in sessions.classified(df).collect()} == want
    with pytest.raises(ValueError):
        sessions.find_space(reg, "nobody")
    assert sessions.find_space(reg, "THREE") == "u3" and sessions.find_space(reg, "U1") == "u1"


def test_plans_and_snapshots(spark):
    src = spark.createDataFrame([("a.jsonl", 5), ("b.jsonl", 5), ("c.jsonl", 5), ("memory/MEMORY.md", 1)], "path string, size long")
    dst = spark.createDataFrame([("b.jsonl", 5), ("c.jsonl", 0)], "path string, size long")
    assert {r["path"]: r["action"] for r in sessions.copy_plan(src, dst).collect()} == {"a.jsonl": "copy", "b.jsonl": "skip", "c.jsonl": "recopy", "memory/MEMORY.md": "never"}
    files = [("u.jsonl", False), ("history.jsonl", False), (".h", False), ("memory", True), ("memory/n.md", False), ("u", True), ("z.txt", False), ("u/deep.jsonl", False)]
    snap = sessions.snapshot(spark.createDataFrame(files, "path string, is_dir boolean"))
    assert {tuple(r) for r in snap.collect()} == {("jsonl", "u"), ("memory", "n.md"), ("subdir", "u"), ("other", "z.txt")}
    after = snap.where("section <> 'other'").unionByName(spark.createDataFrame([("jsonl", "v")], "section string, item string"))
    assert {tuple(r) for r in sessions.snapshot_diff(snap, after).collect()} == {("jsonl", "v", "added"), ("other", "z.txt", "removed")}
    tr = spark.createDataFrame([("p/t.jsonl",)], "path string")
    fs = spark.createDataFrame([("p/t/tool-results/1.txt",), ("p/u/tool-results/1.txt",)], "path string")
    assert [tuple(r) for r in sessions.tool_results(tr, fs).collect()] == [("p/t/tool-results/1.txt", "p/t.jsonl")]


@pytest.mark.parametrize(
    ("status", "dry", "errors", "want"),
    [(["PASS"], False, 0, ("PASS", 0)), (["PASS"], True, 0, ("PARTIAL PASS", 1)), (["FAIL"], True, 0, ("FAIL", 2)), (["PASS"], True, 1, ("FAIL", 2)), (["SKIPPED"], False, 0, ("FAIL", 2)), (["SKIPPED"], True, 0, ("PARTIAL PASS", 1))],
)
def test_verdict(spark, status, dry, errors, want):
    assert tuple(verify.verdict(spark.createDataFrame([(s,) for s in status], "status string"), dry, errors).first()) == want


def test_summary_and_invariants(spark):
    log = lambda *x: spark.createDataFrame(list(enumerate(x)), "lineno int, line string")
    line = sessions.machine_summary(spark.createDataFrame([(2, 0, 0, 0, 0, False)], "transcripts_copied long, transcripts_skipped long, tool_results_copied long, memory_copied long, errors long, dry_run boolean")).first()["line"]
    new = spark.createDataFrame([("a",), ("b",)], "item string")
    status = lambda *x: verify.i2_count_agrees(new, verify.last_summary(log(*x))).first()["status"]
    assert status("x", line, "MACHINE_SUMMARY {bad") == "PASS"
    assert status(line, 'MACHINE_SUMMARY {"transcripts_copied": 3}') == "FAIL" and status("x") == "FAIL"
    assert status('MACHINE_SUMMARY {"dry_run": true, "transcripts_copied": 0}') == "SKIPPED"
    docs = spark.createDataFrame([("ok", '\n {"a": 1}\nbad'), ("bom", "﻿{}"), ("blank", "\n \n"), ("bad", "{")], "item string, content string")
    r = verify.i3_wellformed(docs).first()
    assert r["status"] == "FAIL" and r["items"] == ["bad", "blank"]
    none = spark.createDataFrame([(None,)], "hash string")
    assert verify.i5_same(none, none).first()["status"] == "PASS"


def test_section_reflow(spark):
    rows = [(0.1, 0.1, "My Summary"), (0.2, 0.1, "First line"), (0.22, 0.1, "goes on"), (0.24, 0.1, "• bullet"), (0.26, 0.15, "inner"), (0.28, 0.1, "1. one"), (0.30, 0.1, "tail | x"), (0.50, 0.1, "after gap"), (0.52, 0.1, "t"), (0.6, 0.1, "Next Part")]
    df = spark.createDataFrame([("i-2023-02.png", k, y, x, t) for k, (y, x, t) in enumerate(rows)], "image string, ord int, y double, x double, text string")
    sec = sections.section_rows(df, "summary", "next part")
    md = sections.markdown(sections.blocks(sec)).first()["markdown"]
    assert md == "First line goes on\n\n- bullet\n- inner\n1. one tail I x\n\nafter gap"
    assert sections.section_rows(df, "absent", "x").count() == 0
    none = spark.createDataFrame([], "image string, markdown string")
    period = spark.createDataFrame([("i-2023-02.png", "A – B")], "image string, period string")
    page = sections.pages(df.select("image").distinct(), sections.markdown(sections.blocks(sec)), none, period, "Ada")
    assert sections.document(page).startswith("## February 2023\n*Review period: A – B*\n\n### Self assessment\nFirst line goes on")


def test_json_html_docx(spark):
    up = lambda s: s.upper()
    obj = {"Key": ["a", 1, None, True, {"x": '{"in": ["b"]}'}], "n": "{bad"}
    df = spark.createDataFrame([(json.dumps(obj),), ("﻿[]",), ("{",)], "j string")
    got = [r[0] for r in df.select(documents.json_redact("j", up)).collect()]
    assert json.loads(got[0]) == {"Key": ["A", 1, None, True, {"x": '{"in": ["B"]}'}], "n": "{BAD"} and got[2] is None
    assert df.select(documents.json_strings("j")).first()[0] == ["a", '{"in": ["b"]}', "{bad"]
    cells = spark.createDataFrame([('a,"x\ny"\nb',)], "c string").select(documents.csv_cells("c").alias("c"))
    assert cells.select(documents.csv_text(documents.redact_cells(F.col("c"), F.upper))).first()[0] == 'A,"X\nY"\r\nB\r\n'
    html = '<!doctype html><p class="k">a &amp; b</p><pre>keep <b>me</b></pre><script>let a = 1 < 2;</script><a href="https://x.org/a">Notes</a> <a href="https://x.org">https://x.org</a><br>'
    out = documents.rewrite_html(html, up, lambda h: "[URL]", lambda h: "[x URL]")
    assert out == '<!doctype html><p class="k">A &amp; B</p><pre>keep <b>ME</b></pre><script>let a = 1 < 2;</script><a href="[URL]">NOTES [x URL]</a> <a href="[URL]">HTTPS://X.ORG</a><br>'
    page = spark.createDataFrame([("<head><title>t</title></head><h2>Head</h2><p>Some <b>bold</b> <a href='u'>l</a></p><ul><li>x<li>y</ul>",)], "h string")
    r = page.select(documents.html_markdown("h").alias("m"), documents.html_text("h").alias("t"), documents.html_links("h").alias("l")).first()
    assert r["m"] == "## Head\n\nSome **bold** [l](u)\n\n* x\n* y\n" and r["t"] == "Head Some bold l x y" and r["l"] == ["u"]


def test_docx(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t, p="": f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    cell = lambda t: f"<w:tc><w:p>{run(t)}</w:p></w:tc>"
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr>{run("Title")}</w:p><w:p/><w:p/><w:p>{run("plain ")}{run("bold", "<w:b/>")}{run("both", "<w:b/><w:i/>")}{run("off", "<w:b w:val=&quot;0&quot;/>".replace("&quot;", chr(34)))}</w:p>'
        f'<w:p><w:pPr><w:pStyle w:val="LB"/></w:pPr>{run("item")}</w:p><w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("1")}{cell("2")}</w:tr></w:tbl>'
    )
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("LB", "List Bullet")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {ns}>{styles}</w:styles>")
    want = "# Title\n\nplain **bold*****both***off\n- item\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    df = spark.createDataFrame([("d/x.docx", bytearray(out.getvalue())), ("y.html", bytearray(b"<h1>T</h1>"))], "path string, content binary")
    assert {r["path"]: r["markdown"] for r in documents.convert(df).collect()} == {"d/x.md": want, "y.md": "# T\n"}


def test_boxes(spark):
    obs = spark.createDataFrame([("i", "Ada at x", 0.9, (0, 0, 80, 10)), ("i", "Ada", 0.1, (0, 0, 1, 1))], "image string, text string, confidence double, bbox struct<x0:int,y0:int,x1:int,y1:int>")
    r = Redactor((), (Keyword("ada"),))
    good = images.confident(obs, "vision")
    assert tuple(images.boxes(good, r).first()["bbox"]) == (0, 0, 80, 10) and tuple(images.boxes(good, r, tight=True).first()["bbox"]) == (0, 0, 30, 10)
    assert images.blackout_counts(images.boxes(good, r)).first()["count"] == 1
    with pytest.raises(RuntimeError):
        images.backend("OCR", {})


def test_config(tmp_path):
    assert config.env("A=1 # x\nexport B='q # r' # s\nbad\nC=", True) == {"A": "1", "B": "q # r", "C": ""}
    assert config.env('A="x y"\nB=1 # x') == {"A": "x y", "B": "1 # x"}
    assert config.resolve("K", None, {"K": "e"}, {"K": "d"}) == "e" and config.report_path(None, True) == "redaction-report.md"
    p = tmp_path / "c.yaml"
    p.write_text("replacement: '#'\nocr: {dpi: 300}\nentities:\n")
    cfg = config.load(str(p))
    assert cfg["replacement"] == "#" and cfg["ocr"] == {"dpi": 300} and cfg["entities"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a@b.org",), ("x",)], "text string").write.parquet(f"{tmp_path}/in")
    s = redact_stream(spark, f"{tmp_path}/in", "text string", Redactor(("EMAIL_ADDRESS",)))
    q = tally_stream(s).writeStream.outputMode("complete").format("memory").queryName("tallied").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select matched_text, count from tallied").first()["count"] == 1


def test_entry_and_queries_without_the_subpackage(tmp_path):
    """A copy without llm still imports and registers its other queries; a broken import is still an error."""
    import shutil

    for x in ("siftlane", "__spark_entry__.py"):
        src = os.path.join(ROOT, x)
        shutil.copytree(src, tmp_path / x, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; n = list(e.queries()); assert 'kw_redact' in n and not any(x.startswith('op') for x in n), n"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}).returncode == 0
    (tmp_path / "siftlane/llm").mkdir()
    (tmp_path / "siftlane/llm/__init__.py").write_text("")
    (tmp_path / "siftlane/llm/queries.py").write_text("import no_such_module\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, stderr=subprocess.DEVNULL).returncode == 1


def test_every_query_has_stable_columns(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.columns == ["doc_id", "redacted", "n_redactions"] and got.count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_redaction_inside_formats(spark):
    from siftlane.operators import structured

    r = Redactor(("EMAIL_ADDRESS", "URL"), (Keyword("Ada", "[P-01]"), Keyword("notion", "[N-1]")))
    rows = lambda *t: spark.createDataFrame([(str(i), x) for i, x in enumerate(t)], "path string, text string")
    obj = {"Ada": "Ada", "n": 1, "in": '["a@b.org", {"k": "Ada"}]', "u": "x https://acme.notion.so/p"}
    got = {x["path"]: x for x in structured.redact_json(rows(json.dumps(obj), "{", None), r).collect()}
    assert json.loads(got["0"]["redacted"]) == {"Ada": "[P-01]", "n": 1, "in": '["█████", {"k": "[P-01]"}]', "u": "x [N-1 URL]"}
    assert got["0"]["n_redactions"] == 4 and got["1"]["redacted"] is None and got["2"]["n_redactions"] == 0
    page = '<p>Ada &lt; a@b.org</p><pre>Ada</pre><a href="https://acme.notion.so/p">QA Ada</a><a href="mailto:a@b.org">m</a>'
    x = structured.redact_html(rows(page), r).first()
    assert x["redacted"] == '<p>[P-01] &lt; █████</p><pre>Ada</pre><a href="[URL]">QA [P-01] [N-1 URL]</a><a href="mailto:█████">m</a>' and x["n_redactions"] == 5
    plain = Redactor((), (Keyword("Ada", "[P-01]"),))
    assert structured.redact_html(rows(page), plain).first()["n_redactions"] == 2
    cells = spark.createDataFrame([("0", [["Ada", "a@b.org"], ["x"]])], "path string, cells array<array<string>>")
    c = structured.redact_csv(cells, r).first()
    assert c["cells"] == [["[P-01]", "█████"], ["x"]] and c["n_redactions"] == 2


def test_parsers_get_small_batches(spark):
    rows = documents.BATCH["maxRecordsPerBatch"][1]
    for key, (usual, _) in documents.BATCH.items():
        spark.conf.set(f"spark.sql.execution.arrow.{key}", usual)

    @documents.batched("int")
    def length(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    most = lambda text: spark.range(0, 3000, 1, 1).select(length(F.expr(text)).alias("n")).agg(F.max("n")).first()[0]
    assert most("'a'") == int(rows)
    assert most("repeat('a', 100000)") < 100  # 8 MB
