"""Every operator and every stage over awkward rows and over an empty table."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from siftlane.llm import chat, digest, hpylm, langid, lines, mixing, packing, sharding, simhash, topk
from tests.llm.fixtures import SCHEMA, docs, rows

OPERATORS = {
    "op1": lambda d: langid.identify(d, langid.fit(d, per_language=30)),
    "op2": lambda d: mixing.mix(d),
    "op3": lambda d: lines.drop_similar_lines(d, counted=True),
    "op4": lambda d: digest.fingerprint(d),
    "op5": lambda d: simhash.near_duplicates(d),
    "op7": lambda d: packing.pack(d, seq_len=64, classes=16),
    "op8": lambda d: hpylm.perplexity(d),
    "op10": lambda d: sharding.shard(d, target_bytes=4096),
}
ONE_A_ROW = {"op1", "op3", "op4", "op5", "op8", "op10"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    got = OPERATORS[name](docs(spark)).collect()
    if name in ONE_A_ROW:
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows())
    assert got


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](docs(spark, [])).collect() == []


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf_dir, stage):
    d = docs(spark)
    out = stage(spark, d, sf_dir)
    if stage is not corpus_pipeline.pack_sequences:
        assert out.columns == d.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
    assert out.collect()
    assert stage(spark, docs(spark, []), sf_dir).collect() == []


def test_vectors(spark):
    v = [[1.0, -1.0, 0.5, 0.0], [1.0, 1.0, 1.0, 1.0], [-1.0, -1.0, -1.0, -1.0], [float("nan")] * 4]
    data = [(i, x, "a", "b") for i, x in enumerate(v)] + [(1, v[1], "a", "b"), (None, v[0], "a", "b"), (9, None, "a", "b"), (10, [1.0], "a", "b"), (11, [None, 1.0, 1.0, 1.0], "a", "b")]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>, words string, block string")
    got = topk.nearest(d, k=10, every=1).collect()
    signs = [[0 if x != x else int(x > 0) for x in r] for r in v]
    assert {(r["vec_id"], r["neighbor_id"], r["distance"]) for r in got} == {(a, b, sum(x != y for x, y in zip(signs[a], signs[b], strict=True))) for a in range(4) for b in range(4) if a != b}
    assert {r["vec_id"] for r in topk.nearest(d, k=10).collect()} == {0}
    assert topk.nearest(d.limit(0)).collect() == []
    # the most frequent length counts, of equally frequent ones the longest
    mixed = spark.createDataFrame([(i, [1.0] * (3 if i < 4 else 2)) for i in range(8)] + [(8, [1.0] * 9)], "vec_id long, embedding array<float>")
    assert {r["vec_id"] for r in topk.nearest(mixed, every=1).collect()} == {0, 1, 2, 3}


def test_conversations(spark):
    data = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 1, "assistant", "yes"),
        (4, 0, None, None), (5, None, "user", "<|start|>"), (None, 0, "user", "lost"), (6, 0, "user", ""), (7, 0, "user", "x" * 300_000),
    ]
    d = spark.createDataFrame([r + ("z", "z") for r in data], "conv_id long, turn long, role string, text string, pos string, h1 string")
    got = {r["conv_id"]: r for r in chat.format_chats(d).collect()}
    assert set(got) == {1, 4, 5, None, 6, 7}
    assert got[1]["rendered"] == "<|start|>user\nhi<|end|>\n<|start|>assistant\nyes<|end|>\n" and got[1]["n_turns"] == 2
    assert got[4]["rendered"] == "<|start|>unknown\n<|end|>\n"
    assert got[5]["rendered"] == "<|start|>user\n< |start|><|end|>\n"
    assert chat.format_chats(d.limit(0)).collect() == []


def test_schema_has_clashes():
    assert "k_id" in SCHEMA
