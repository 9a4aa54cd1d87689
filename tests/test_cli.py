"""The command line on small folders: routing, leak guard, names, exit codes, reports, names file."""

from __future__ import annotations

import json
import os
import re

import pytest

from siftlane.__main__ import main

MAIL = "write to a@b.org and Ada"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "Ada notes").mkdir(parents=True)
    for name, body in {
        "Ada notes/a.md": MAIL, "b.txt": MAIL, "c.html": f"<p>{MAIL}</p>", "d.json": json.dumps({"k": MAIL}), "e.csv": f"x,{MAIL}\n", "bad.json": "{", "code.py": MAIL, "raw.csv": b"\xff\xfe,x",
        "redacted/old.md": MAIL, "redaction-report.md": MAIL,
    }.items():
        p = root / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())
    return root


def _config(tmp_path, **settings):
    p = tmp_path / "c.yaml"
    p.write_text(json.dumps({"entities": ["EMAIL_ADDRESS"], "custom_keywords": [{"find": "Ada", "replace": "[P-01]"}], "output_dir": "out"} | settings))
    return str(p)


def _files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_redacts_all_formats_under_new_names(spark, folder, tmp_path, capsys):
    cfg = _config(tmp_path, redact_filenames=True, filename_min_match_len=3, timestamp_outputs=True, copy_unhandled=True)
    assert main(["redact", str(folder), "--config", cfg, "--report"]) == 2
    (made,) = [d for d in os.listdir(folder) if d.startswith("out-")]
    assert re.fullmatch(r"out-\d{8}-\d{6}", made)
    out = folder / made
    assert _files(out) == ["P-01 notes/a.md", "b.txt", "c.html", "code.py", "d.json", "e.csv", "redacted/old.md"]
    for f in _files(out):
        clean = (out / f).read_text()
        assert clean == MAIL if f == "code.py" else "a@b.org" not in clean and "[P-01]" in clean
    said = capsys.readouterr()
    assert "failed: bad.json" in said.err and "failed: raw.csv" in said.err and "GRAND TOTAL: 12 redactions across 6 files" in said.out
    (report,) = [f for f in os.listdir(folder) if f.startswith("redaction-report-")]
    text = (folder / report).read_text()
    assert "FILENAME REDACTIONS" in text and "| failed | 2 |" in text and "| copied | 1 |" in text


def test_nothing_is_written_without_a_backend(spark, folder, tmp_path, capsys):
    assert main(["redact", str(folder)]) == 1 and not (folder / "redacted/b.txt").exists()
    assert "PERSON" in capsys.readouterr().err
    (folder / "scan.pdf").write_bytes(b"%PDF")
    assert main(["redact", str(folder), "--config", _config(tmp_path)]) == 1 and not (folder / "out").exists()


def test_extension_lists(spark, folder, tmp_path, capsys):
    cfg = _config(tmp_path, skip_extensions=[".json", ".csv"], entities=["PERSON"], regex_only=True)
    assert main(["redact", str(folder), "--include", "txt", "--config", cfg]) == 0
    assert _files(folder / "out") == ["b.txt"] and "[P-01]" in (folder / "out/b.txt").read_text()
    said = capsys.readouterr().out
    assert "uncopied: 4" in said and "skip: 4" in said


def test_throttle(spark, folder, tmp_path, capsys):
    names, cfg = tmp_path / "names.md", tmp_path / "c.yaml"
    cfg.write_text(f"entities: []\noutput_dir: out\ninclude_extensions: [.txt]\nnames_file: {names}\ncustom_keywords:\n  # names: begin\n  # names: end\n")
    old = cfg.read_text()
    args = ["throttle", str(folder), "--config", str(cfg)]
    assert main(args) == 1
    names.write_text("# P\n- Ada, ada\n")
    assert main(args) == 1 and cfg.read_text() == old
    names.write_text("# P\n- Ada\n")
    assert main([*args, "--preview"]) == 0 and cfg.read_text() == old and not (folder / "out").exists()
    assert "[P-01]" in capsys.readouterr().out
    assert main(args) == 0 and (tmp_path / "c.yaml.bak").read_text() == old and "[P-01]" in cfg.read_text()
    assert "[P-01]" in (folder / "out/b.txt").read_text()
    cfg.write_text("entities: [EMAIL_ADDRESS]\n")
    assert main(args) == 1
