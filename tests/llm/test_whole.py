"""Whole registered queries on the smallest tables, and awkward rows, against brute force."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from siftlane.llm import digest, langid, lines, mixing, packing, queries, sharding, simhash
from siftlane.llm.common import mix
from tests.llm import brute
from tests.llm.fixtures import docs, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return d, [tuple(r) for r in d.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark), rows()


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_op1(spark, request, which):
    d, data = request.getfixturevalue(which)
    model = langid.fit(d)
    got = queries.op1_language_id(spark, SF) if which == "table" else langid.identify(d, model)
    want = defaultdict(list)
    for i, text, *_ in data:
        want[i].append(brute.language(model, text))
    seen = defaultdict(list)
    for r in got.collect():
        seen[r["doc_id"]].append((r["language"], r["distance"], r["accepted"]))
    assert set(seen) == set(want)
    for i, x in want.items():
        key = lambda y: (y[1], str(y[0]))
        for (a, da, oka), (b, db, okb) in zip(sorted(x, key=key), sorted(seen[i], key=key), strict=True):
            assert a == b and abs(da - db) < 1e-3 and oka == okb


def test_op2(spark, table):
    _, data = table
    quality: dict = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        quality[r["doc_id"]] = max(r["quality"], quality.get(r["doc_id"], -1))
    got = Counter({(r["doc_id"], r["source"], r["tokens"]): r["copies"] for r in queries.op2_mixing(spark, SF).collect()})
    assert got == brute.mix([(i, t, s) for i, t, _, s, _ in data], quality)


def test_op2_nulls_and_repeats(awkward):
    d, data = awkward
    got: Counter = Counter()
    for r in mixing.mix(d).collect():
        got[(r["doc_id"], r["source"], r["tokens"])] += r["copies"]
    assert got == brute.mix([(r[0], r[1], r[3]) for r in data], {})


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_op3(spark, request, which):
    d, data = request.getfixturevalue(which)
    got = queries.op3_line_dedup(spark, SF) if which == "table" else lines.drop_similar_lines(d, counted=True)
    gone = brute.removed_lines([(r[0], r[1]) for r in data])
    want = Counter((i, brute.without(t, gone[(i, t)]), t.count("\n") + 1 if t is not None else 0, len(gone[(i, t)])) for i, t, *_ in data)
    assert Counter(tuple(r[c] for c in ("doc_id", "text", "n_lines", "n_removed")) for r in got.collect()) == want


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_op4(spark, request, which):
    d, data = request.getfixturevalue(which)
    got = (queries.op4_fingerprint(spark, SF) if which == "table" else digest.fingerprint(d)).collect()
    by = defaultdict(list)
    for k, (i, t, *_) in enumerate(data):
        by[("null", k) if t is None else brute.canonical(t)].append(i)
    want: Counter = Counter()
    for ids in by.values():
        known = [i for i in ids if i is not None]
        want.update((i, min(known) if known else None, len(ids)) for i in ids)
    assert Counter((r["doc_id"], r["group_id"], r["group_size"]) for r in got) == want
    assert sum(r["keep"] for r in got) == len(by)
    prints = defaultdict(set)
    for r in got:
        if r["fingerprint"] is not None and r["doc_id"] is not None:
            prints[r["fingerprint"]].add(r["doc_id"])
    assert {frozenset(x) for x in prints.values()} == {frozenset(i for i in ids if i is not None) for f, ids in by.items() if isinstance(f, bytes)} - {frozenset()}


def test_fingerprint_is_the_weighted_sign_of_each_bit():
    h = mix(np.arange(40, dtype=np.uint64))[np.random.default_rng(1).integers(0, 40, 300)]
    seeds = [int(x) for x in simhash._SEEDS]
    total = np.zeros((2, 256))
    for w, n in Counter(h.tolist()).items():
        for k, s in enumerate(seeds):
            x = int(mix(np.array([w ^ s], np.uint64))[0])
            for b in range(64):
                sign = 1 if x >> b & 1 else -1
                total[:, 64 * k + b] += sign * np.array([n**0.85, n**0.5])
    got = np.unpackbits(simhash._fingerprint(h).view(np.uint8), bitorder="little")
    want = np.concatenate([total[0, :128] > 0, total[1, 128:] > 0])
    sure = np.abs(np.concatenate([total[0, :128], total[1, 128:]])) > 1e-3
    assert (got[sure] == want[sure]).all()


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_op5(spark, request, which):
    d, data = request.getfixturevalue(which)
    got = (queries.op5_simhash_near_dedup(spark, SF) if which == "table" else simhash.near_duplicates(d)).collect()
    prints = simhash.fingerprints(d).collect()
    of = brute.groups([tuple(r[f"f{i}"] for i in range(4)) for r in prints], simhash.BLOCKS, simhash.BLOCK_K, simhash.COVER_K, simhash.CONFIRM_K)
    by = defaultdict(list)
    for r, g in zip(prints, of, strict=True):
        by[g].append(r["doc_id"])
    want: Counter = Counter()
    for ids in by.values():
        known = [i for i in ids if i is not None]
        want.update((i, min(known) if known else None, len(ids)) for i in ids)
    assert Counter((r["doc_id"], r["group_id"], r["group_size"]) for r in got) == want
    assert sum(r["keep"] for r in got) == len(by) and all(r["doc_id"] == r["group_id"] for r in got if r["keep"])
    left = simhash.drop_near_duplicates(d)
    assert left.columns == d.columns and Counter(r["doc_id"] for r in left.collect()) == Counter(r["doc_id"] for r in got if r["keep"])


def _pieces(data: list[tuple], seq: int, classes: int) -> list[tuple]:
    out = []
    for i, t, *_ in data:
        n = len(brute.words(t))
        out += [(i, brute.hash64(t), k, k * seq, min(seq, n - k * seq)) for k in range(-(-n // seq))]
    out.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    return [(-(-x[4] // (seq // classes)), x) for x in out]


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_op7(spark, request, which):
    d, data = request.getfixturevalue(which)
    seq, classes, depth = (packing.SEQ_LEN, packing.CLASSES, packing.DEPTH) if which == "table" else (64, 16, 3)
    got = (queries.op7_best_fit_packing(spark, SF) if which == "table" else packing.pack(d, seq, classes, depth)).collect()
    pieces = _pieces(data, seq, classes)
    histogram = np.bincount([c for c, _ in pieces], minlength=classes + 1)[1:]
    plan = packing.fit(histogram, depth)
    want = Counter((q, s, x[0], x[2], x[3], x[4]) for q, s, x in brute.placed([(c, (*x, n)) for n, (c, x) in enumerate(pieces)], plan))
    assert Counter(tuple(r[c] for c in ("seq_id", "slot", "doc_id", "piece", "first_token", "n_tokens")) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r["seq_id"]].append(r)
    for s in filled.values():
        s.sort(key=lambda r: r["slot"])
        assert [r["at"] for r in s] == [sum(x["n_tokens"] for x in s[:k]) for k in range(len(s))] and sum(r["n_tokens"] for r in s) <= seq


def test_nnls_against_another_solver():
    """Projected gradient steps on small problems end at no lower a distance."""
    rng = np.random.default_rng(4)
    for _ in range(10):
        a, b = rng.random((10, 6)), rng.random(10)
        x, step = np.zeros(6), 1 / np.linalg.norm(a, 2) ** 2
        for _ in range(20_000):
            x = np.maximum(0, x - step * a.T @ (a @ x - b))
        assert np.linalg.norm(a @ packing.nnls(a, b) - b) <= np.linalg.norm(a @ x - b) + 1e-6


@pytest.mark.parametrize("which", ["table", "awkward"])
@pytest.mark.parametrize("target", [4_000, 60_000, None])
def test_op10(spark, request, which, target):
    d, data = request.getfixturevalue(which)
    got = sharding.shard(d, target_bytes=target) if target else queries.op10_sharding(spark, SF) if which == "table" else sharding.shard(d)
    want = brute.shards([(i, t, s, lang) for i, t, lang, s, *_ in data], target or sharding.TARGET_BYTES)
    assert Counter((r["doc_id"], r["shard"]) for r in got.collect()) == want


def test_pipeline(spark, table):
    """Every stage by brute force on what the one before leaves."""
    d, data = table
    model = langid.fit(d)
    kept = [r for r in data if brute.language(model, r[1])[2]]
    gone = brute.removed_lines([(r[0], r[1]) for r in kept])
    clean = [(r[0], brute.without(r[1], gone[(r[0], r[1])]), r[2], r[3]) for r in kept]
    clean = [c for c, r in zip(clean, kept, strict=True) if not gone[(r[0], r[1])] or brute.words(c[1])]
    prints = {r["doc_id"]: tuple(r[f"f{i}"] for i in range(4)) for r in simhash.fingerprints(spark.createDataFrame([c[:2] for c in clean], "doc_id long, text string")).collect()}
    of = brute.groups([prints[c[0]] for c in clean], simhash.BLOCKS, simhash.BLOCK_K, simhash.COVER_K, simhash.CONFIRM_K)
    first: dict = {}
    for c, g in sorted(zip(clean, of, strict=True), key=lambda x: x[0][0]):
        first.setdefault(g, c)
    one = list(first.values())
    quality: dict = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        quality[r["doc_id"]] = max(r["quality"], quality.get(r["doc_id"], -1))
    copies = brute.mix([(c[0], c[1], c[3]) for c in one], quality)
    taken = [(c[0], c[1]) for c in one for _ in range(copies[(c[0], c[3], len(brute.words(c[1])))])]
    pieces = _pieces(taken, packing.SEQ_LEN, packing.CLASSES)
    plan = packing.fit(np.bincount([c for c, _ in pieces], minlength=packing.CLASSES + 1)[1:])
    want = Counter((q, s, x[0], x[2], x[4]) for q, s, x in brute.placed([(c, (*x, n)) for n, (c, x) in enumerate(pieces)], plan))
    assert Counter(tuple(r[c] for c in ("seq_id", "slot", "doc_id", "piece", "n_tokens")) for r in corpus_pipeline.run(spark, SF).collect()) == want
    assert math.isfinite(sum(want.values()))
