"""Registered queries against their SQL on rows that the tables seldom have."""

from __future__ import annotations

import duckdb
import pytest

from siftlane.operators import verify
from siftlane.plans import queries


def agrees(spark, folder, name: str, **tables: tuple[str, list]) -> list:
    """The rows of a query, which its SQL returns too."""
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    got = [tuple(r) for r in queries.queries()[name](spark, str(folder)).collect()]
    with duckdb.connect() as db:
        for table in tables:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
        want = db.execute(queries.oracle_sql()[name]).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


JSON = ["4397110767823743 +1 (654) Ab.", "123 45", '{"a": 1} x', '{"a": 1}}', '"a" "b"', '"a"], ["b"', "1], [2", "1, 2", "1 // c", '{"a": 1, "a": 2}', "NaN", "'a'", "[1", "", " ", "null", "12", ' {"a": [1, "b"]}\nrest', "\n{}", None, "[" * 900 + "]" * 900, "1" * 1500, "[1 2]", '"\\\'"']


@pytest.mark.parametrize("name", ["jsonl_wellformed", "verify_i3"])
def test_a_line_is_json_as_a_whole(spark, tmp_path, name):
    documents = ("doc_id long, text string", list(enumerate(JSON)))
    events = ("event_id long, props string", [(i, x) for i, x in enumerate(JSON) if x is None or "\n" not in x])
    agrees(spark, tmp_path, name, documents=documents, events=events)


def test_a_summary_is_json_as_a_whole(spark):
    line = 'MACHINE_SUMMARY {"transcripts_copied": %d, "dry_run": false}'
    log = spark.createDataFrame([(1, line % 1), (2, line % 2 + " x {}")], "lineno int, line string")
    assert verify.last_summary(log).first()["s"]["transcripts_copied"] == 1


#: lengths of lines, in hundreds of signs; each 4 lower a line by 0.001: gaps of just 1.6 medians, medians between two thousandths
LINES = [[0, 48, 48, 48, 48], [1] * 7 + [49] * 9, [0, 0, 4], [0, 4, 4, 60, 60], [0, 80, 0, 0], [0, 56, 60, 60, 64], [3], [0, 0], [0, 6, 0, 99, 0, 52, 52]]


@pytest.mark.parametrize("name", ["section_reflow", "section_markdown", "section_slice"])
def test_gaps_of_just_so_many_medians(spark, tmp_path, name):
    text = lambda n, k: "\n".join(["Heading", *(f"{chr(98 + k)}" + "b" * (100 * x) + " c." for x in n)])
    rows = [(10 * i + k, "a\n" * k + text(n, k)) for i, n in enumerate(LINES) for k in range(4)]
    assert agrees(spark, tmp_path, name, documents=("doc_id long, text string", [*rows, (900, None), (901, "")]))
