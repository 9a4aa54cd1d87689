"""Spans, keywords, patterns and reports against plain-Python models."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siftlane.functions import spans
from siftlane.functions import text as tx
from siftlane.operators import keywords as kw
from siftlane.operators import recognizers as rec
from siftlane.operators import report
from siftlane.operators.keywords import BLOCK, Keyword
from siftlane.operators.redact import Redactor, scan, tally
from siftlane.plans import queries


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def model_keywords(text, words, default=BLOCK):
    by = {k.find.lower(): default if k.replace is None else k.replace for k in words}
    alts = "|".join(map(re.escape, sorted((k.find for k in words), key=len, reverse=True)))
    p = re.compile(rf"\b(?:{alts})\b", re.IGNORECASE)
    return p.sub(lambda m: by[m.group().lower()], text), len(p.findall(text))


def test_keywords_match_the_model(spark):
    words = [Keyword("the", "[A]"), Keyword("and the", "and"), Keyword("über"), Keyword("C++", "[C]"), Keyword("a.b", "[D]")]
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "and", "AND THE", "Über", "ÜBER,", "C++x", "a.b", "axb", "x\ny", "theé"]) for _ in range(12)) for _ in range(200)] + ["", "the"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", kw.redact("t", words).alias("r"), kw.count("t", words).alias("n")).collect()
    for r in got:
        assert (r["r"], r["n"]) == model_keywords(texts[r["i"]], words)


def test_keywords_without_table_and_null(spark):
    assert one(spark, "abc", kw.redact("t", [])) == "abc"
    assert one(spark, None, kw.redact("t", [Keyword("a")])) is None


def test_offsets_match_finditer(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\n1") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("i", spans.find_all("t", r"(?iuU)\w+", "W").alias("x")).collect():
        assert [(x["s"], x["e"], x["text"]) for x in r["x"]] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\w+", texts[r["i"]])]


def model_deoverlap(found):
    kept = []
    for r in sorted(found, key=lambda r: (r[0] - r[1], r[2])):
        if not any(k[0] <= r[0] and r[1] <= k[1] for k in kept):
            kept.append(r)
    return kept


def test_deoverlap_and_splice_match_the_model(spark):
    rng = random.Random(3)
    text = "abcdefghijklmnopqrstuvwxyz"
    cases = [[(a := rng.randint(0, 20), a + rng.randint(1, 6), k) for k in range(rng.randint(0, 5))] for _ in range(300)]
    data = [(i, text, [(f"E{k}", a, b, k, text[a:b]) for a, b, k in c]) for i, c in enumerate(cases)]
    rows = spark.createDataFrame(data, f"i int, t string, x array<{spans.SPAN}>").withColumn("k", spans.deoverlap(F.col("x")))
    got = rows.select("i", "k", spans.replace("t", F.col("k"), lambda s: F.lit("##")).alias("r"), spans.merge_overlaps(F.col("k")).alias("m")).collect()
    for r in got:
        want = model_deoverlap(cases[r["i"]])
        assert sorted((x["s"], x["e"]) for x in r["k"]) == sorted(w[:2] for w in want)
        buf = list(text)
        for a, b, _ in sorted(want, key=lambda w: (-w[0], w[2])):
            buf[a:b] = "##"
        assert r["r"] == "".join(buf)
        ends = sorted((x["s"], x["e"]) for x in r["m"])
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
        assert {c for a, b in ends for c in range(a, b)} == {c for a, b, _ in want for c in range(a, b)}


@pytest.mark.parametrize(
    ("entity", "yes", "no"),
    [
        ("EMAIL_ADDRESS", ["a.b@c-d.org", "X@Y.CO.UK"], ["a@b", "@x.org"]),
        ("IP_ADDRESS", ["10.0.0.255", "2001:0db8:0:0:0:0:0:1"], ["10.0.0.256", "1.2.3.4.5", "1.2.3"]),
        ("CREDIT_CARD", ["4111 1111 1111 1111", "4111111111111111"], ["4111111111111112", "1234"]),
        ("IBAN_CODE", ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], ["DE88370400440532013000"]),
        ("US_SSN", ["123-45-6789"], ["000-45-6789", "123-00-6789", "1234-45-6789"]),
        ("PHONE_NUMBER", ["+49 30 1234 5678", "(555) 123-4567", "555-123-4567"], ["12-34", "2024"]),
        ("URL", ["https://x.org/a?b", "HTTP://Y"], ["ftp://x"]),
        ("US_ITIN", ["912-70-1234"], ["912-93-1234", "812-70-1234"]),
        ("MEDICAL_LICENSE", ["AB1234567"], ["ZB1234567"]),
        ("CRYPTO", ["1BoatSLRHtKNngkdXEeobR76b53LETtpyT"], ["0BoatSLRHtKNngkdXEeobR76b53LETtpyT"]),
    ],
)
def test_patterns(spark, entity, yes, no):
    rows = spark.createDataFrame([(v, v in yes) for v in (*yes, *no)], "v string, ok boolean")
    found = rows.select("v", "ok", rec.PATTERNS[entity].find(F.concat(F.lit("see "), "v", F.lit(" now")), 0).alias("x")).collect()
    assert {r["v"] for r in found if r["ok"] != (r["v"] in [x["text"] for x in r["x"]])} == set()


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://acme.atlassian.net/x", "[atlassian URL]"), ("http://notion.so", "[notion URL]"), ("https://localhost:8080/", "[localhost URL]"), ("https://user:pw@random-co.com?q", "[random-co URL]"),
        ("https://Example.COM).", "[example URL]"), ("mailto:a@b.c", "[URL]"), ("https://", "[URL]"), ("https://corp.io/a", "[X-1 URL]"),
    ],
)
def test_url_token(spark, url, want):
    assert one(spark, url, tx.url_token("t", {"corp": "[X-1]"})) == want


def test_redactor_modes(spark):
    rows = spark.createDataFrame([(1, "Ada at ada@x.org, see https://acme.notion.so/p"), (2, "  "), (3, None)], "id int, text string")
    r = Redactor(("EMAIL_ADDRESS", "URL", "PERSON"), (Keyword("Ada", "[P-01]"), Keyword("notion", "[N-1]")), models=(rec.gazetteer("PERSON", ["Ada"]),))
    got = {x["id"]: x for x in r.apply(rows).collect()}
    assert got[1]["redacted"] == "[P-01] at █████, see [N-1 URL]" and got[1]["n_redactions"] == 3
    assert got[2]["redacted"] == "  " and got[2]["n_redactions"] == 0 and got[3]["redacted"] is None
    assert r.mode == "ner" and Redactor(("EMAIL_ADDRESS",)).mode == "regex" and Redactor((), (Keyword("a"),)).mode == "keyword"
    raw = {(x["entity"], x["matched_text"]) for x in scan(rows, r).collect()}
    assert ("KW_1", "notion") in raw and ("URL", "https://acme.notion.so/p") in raw
    with pytest.raises(RuntimeError, match="no OCR backend"):
        rec.unavailable("OCR")


def test_report_totals_and_text(spark):
    words = [Keyword("ada", "[P-01]"), Keyword("grace", "[P-01]"), Keyword("falcon"), Keyword("never")]
    rows = spark.createDataFrame([("Ada ada grace falcon a@b.org",), ("a@b.org c@d.org",)], "text string")
    r = Redactor(("EMAIL_ADDRESS",), tuple(words))
    t = tally(r.apply(rows))
    k = report.keyword_tally(t, kw.table(spark, words))
    built = report.build(t, k, BLOCK)
    assert built["grand_total"] == 7 == t.agg(F.sum("count")).first()[0]
    assert built["pattern"] == [("EMAIL_ADDRESS", 2, 3, BLOCK, [("a@b.org", 2), ("c@d.org", 1)])]
    assert built["blackout"] == [("falcon", 1)] and built["replaced"] == [("[P-01]", 2, 3, [("ada", 2), ("grace", 1)])]
    flags = report.engaged(["EMAIL_ADDRESS"], False, words)
    how = {"scanned": 2, "matched": 2}
    real, dry = report.render(built, flags, "DONE", output="out", **how), report.render(built, flags, "PREVIEW", **how)
    assert [x for x in real.split("\n") if "Output at" not in x and "DONE" not in x] == [x for x in dry.split("\n") if "PREVIEW" not in x]
    assert "N/A    ← no model types were asked for" in real and "GRAND TOTAL: 7 redactions across 2 files" in real
    assert "| GRAND TOTAL | 7 |" in report.render_markdown(built, flags, "H", ["x", ("Mode", "regex")], [("Errors", 0)], title="T", **how)
    assert "EMAIL_ADDRESS  (2 unique)" in report.render_scan(t.where("entity = 'EMAIL_ADDRESS'").collect())
    assert report.render_scan([]) == "  No candidate entities found."


def test_failed_rows_are_left_out_of_the_tally(spark):
    rows = spark.createDataFrame([("a@b.org", True), ("c@d.org", False)], "text string, ok boolean")
    t = tally(Redactor(("EMAIL_ADDRESS",)).apply(rows), ok=F.col("ok"))
    assert [r["matched_text"] for r in t.collect()] == ["a@b.org"]


def test_names_list(spark):
    lines = ["Nobody", "# ENG", "- Ada, Ada L", "Bob", "#", "lost", "# BLACKOUT", "x, y", "# [OPS]", "Zoe", "# ENG", "Ann, ada"]
    df = spark.createDataFrame(list(enumerate(lines)), "lineno int, line string")
    got = {r["find"]: r["code"] for r in kw.codes(df).collect()}
    assert got == {"Ada": "[ENG-01]", "Ada L": "[ENG-01]", "Bob": "[ENG-02]", "x": None, "y": None, "Zoe": "[OPS-01]", "Ann": "[ENG-03]", "ada": "[ENG-03]"}
    assert [tuple(r) for r in kw.duplicate_finds(df).collect()] == [("ada", 2)]
    text = kw.yaml_entries(kw.codes(df).collect())
    assert '  - find: "Bob"\n    replace: "[ENG-02]"' in text and '  - "x"' in text
    assert kw.splice("a\n# >>\nold\n# <<\nb", "new", ">>", "<<") == "a\n# >>\nnew\n# <<\nb"
    with pytest.raises(ValueError):
        kw.splice("a", "b", ">>", "<<")
    with pytest.raises(ValueError):
        kw.validate([{"find": "A", "replace": "x"}, {"find": "a", "replace": "y"}])


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (tx.fix_ocr, "| l've | x|y ol'm", "I I've I x|y ol'm"), (tx.sanitize, "[P/01] x", "P_01_x"), (tx.sanitize, "///", "REDACTED"), (tx.shown, " a \n b ", "a b"), (tx.shown, "\n\t", "'\\n\\t'"),
        (tx.suffix, "a/.bashrc", ""), (tx.suffix, "a.b/c.tar.gz", ".gz"), (tx.suffix, "a.b/c", ""), (tx.stem, "x/y.z.md", "y.z"), (lambda c: tx.pad(c, 5), "ab", "ab   "), (lambda c: tx.pad(c, 1), "ab", "ab"),
        (lambda c: tx.stamped(c, "T"), "out/r.md", "out/r-T.md"), (tx.review_period, "x Jan 1, 2023 - Feb 2, 2024", "Jan 1, 2023 – Feb 2, 2024"), (tx.review_period, "no", None),
        (lambda c: tx.date_of(c)["label"], "shot-2023_02", "February 2023"), (lambda c: tx.date_of(c)["label"], "shot-2023-13", "shot-2023-13"), (lambda c: tx.date_of(c)["label"], "none", "none"),
        (lambda c: F.array_join(tx.lines(c), "/"), "a\r\nb\x1cc\n", "a/b/c"), (lambda c: tx.is_uuid(c).cast("string"), "0A0a0a0a-0000-1111-2222-333333333333", "true"), (lambda c: tx.looks_like_json(c).cast("string"), " [1", "true"),
    ],
)
def test_text_functions(spark, column, text, want):
    assert one(spark, text, column("t")) == want


def test_boxes_and_decoding(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.5, 0.3, 100, 200)], "x double, y double, w double, h double, wide int, high int")
    b = df.select(tx.pixel_box(*(F.col(c) for c in ("x", "y", "w", "h", "wide", "high"))).alias("b"), tx.crop_scale(F.lit(3.0), F.lit(4000.0), F.lit(100.0)).alias("s")).first()
    assert tuple(b["b"]) == (8, 98, 62, 162) and b["s"] == 2.0
    raw = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfa\xffb"),)], "b binary")
    assert raw.select(tx.decode("b", bom=True)).first()[0] == "a�b"
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        raw.select(tx.decode("b", strict=True)).collect()
    assert spark.range(1).select(tx.iso_time(F.lit(1.5))).first()[0] == "1970-01-01T00:00:01.500000"


def test_replace_is_linear_and_keeps_every_sign(spark):
    signs = "a\ufeff\u00e9\u6f22\U0001f600\n"
    text = "\ufeff" + "".join(signs[i % 6] for i in range(600_000))
    at = range(1, 600_001, 20)
    rows = spark.createDataFrame([(text,)], "text string")
    kept = F.transform(F.sequence(F.lit(1), F.lit(600_000), F.lit(20)), lambda s: F.struct(F.lit("E").alias("entity"), s.alias("s"), (s + 2).alias("e"), F.lit(0).alias("ord"), F.lit("").alias("text")))
    began = time.time()
    got = rows.select(spans.replace("text", kept, lambda _: F.lit("[\U0001f600]")).alias("x")).first()["x"]
    assert time.time() - began < 20  # the text was scanned and copied anew for each span: minutes
    assert got == text[:1] + "".join("[\U0001f600]" + text[s + 2 : s + 20] for s in at)


def test_partial_overlaps_are_spliced_last_first(spark):
    span = lambda s, e: ("E", s, e, 0, "")
    rows = spark.createDataFrame([("abcdefghij", [span(0, 2), span(3, 6), span(5, 8)])], f"t string, k array<{spans.SPAN}>")
    assert rows.select(spans.replace("t", F.col("k"), lambda _: F.lit("<>")).alias("x")).first()["x"] == "<>c<>>ij"


def test_needs_let_every_match_pass(spark):
    found = {
        "EMAIL_ADDRESS": "a@b.org", "PHONE_NUMBER": "+1 (654) 555-4136", "CREDIT_CARD": "4111 1111 1111 1111", "CRYPTO": "1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "IBAN_CODE": "DE89 3704 0044 0532 0130 00",
        "IP_ADDRESS": "fe:ab:cd:ef:fe:ab:cd:ef", "US_SSN": "123-45-6789", "US_BANK_NUMBER": "account 12345678", "US_DRIVER_LICENSE": "A123-4567-8901", "US_ITIN": "912-70-1234", "US_PASSPORT": "passport A12345678", "MEDICAL_LICENSE": "AB1234567", "URL": "http://a.b",
    }
    assert set(found) == set(rec.PATTERNS)
    for entity, text in found.items():
        assert len(one(spark, f"x {text} y", rec.PATTERNS[entity].find("t", 0))) == 1, entity


def test_a_total_searches_the_texts_once(spark, tmp_path):
    spark.createDataFrame([(1, "the a@b.org and The 10.0.0.1")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    total = queries.queries()["grand_total"](spark, str(tmp_path))
    assert total.first()[0] == 5
    assert total._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
