"""Each operator against a brute-force version, an invariant or held-out accuracy."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlane.llm import chat, digest, hpylm, langid, lines, mixing, packing, sharding, simhash, topk
from siftlane.llm.common import chunks, tokens
from tests.llm.fixtures import _EN, _FR, docs, rows, sentence

SF = "/root/testdata/sf0.001"


# tokens
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t.", max_size=30), max_size=6))
def test_tokens_are_those_of_split(texts):
    want = [[t for t in x.replace("\t", " ").replace("\n", " ").split(" ") if t] for x in (s.lower() for s in texts)]
    seen: dict[str, int] = {}
    for first, data, offs in chunks(pa.array(texts, pa.string())):
        start, h = tokens(data, offs)
        cut = np.searchsorted(start, offs)
        for i in range(len(offs) - 1):
            got = h[cut[i] : cut[i + 1]].tolist()
            assert len(got) == len(want[first + i])
            for w, x in zip(want[first + i], got, strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# 1
def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    got = {r["doc_id"]: r for r in langid.identify(held, langid.fit(train)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in held.select("doc_id", "lang").collect()}
    took = [i for i, r in got.items() if r["accepted"]]
    assert len(took) > 0.85 * len(truth)
    assert sum(got[i]["language"] == truth[i] for i in took) / len(took) > 0.98


def test_language_rejects_what_is_none():
    rng = random.Random(3)
    train = [(lang, sentence(rng, w, 60)) for lang, w in (("en", _EN), ("fr", _FR)) for _ in range(60)]
    m = langid.fit_texts(train)
    tests = {"en": sentence(rng, _EN, 60), "fr": sentence(rng, _FR, 60), None: "zxq wvk jjq xxz qqk " * 20}
    for want, text in tests.items():
        own, _, ok = m.nearest(np.array([langid.counts(np.frombuffer(text.lower().encode(), np.uint8))]))
        assert (m.languages[own[0]] if ok[0] else None) == want


# 2
def test_mixing_against_brute_force(spark):
    from hashlib import md5

    d = docs(spark)
    quality = {1: 1, 2: 0, 5: 1, 106: 0}
    q = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    weights = {"src0": 3.0, "src1": 1.0, "src3": 0.5}
    got = {(r["doc_id"], r["source"], r["tokens"]): r["copies"] for r in mixing.mix(d, q, weights, budget=30_000, seed=3).collect()}
    items = defaultdict(list)
    for r in rows():
        n = len((r[1] or "").split())
        u = (int(md5(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        items[r[3]].append((-math.log(u) / mixing.QUALITY.get(quality.get(r[0]), 1.0), -1 if r[0] is None else r[0], n, r))
    want = {}
    for s, w in weights.items():
        total = sum(x[2] for x in items[s])
        budget = 30_000 * w / sum(weights.values())
        epochs, rest = int(budget // total), budget % total
        for key, i, n, r in items[s]:
            upto = sum(x[2] for x in items[s] if (x[0], x[1]) <= (key, i))
            if copies := epochs + (upto <= rest):
                want[(r[0], s, n)] = copies
    assert got == want


def test_mixed_repeats_rows(spark):
    d = docs(spark)
    plan = {(r["doc_id"], r["tokens"]): r["copies"] for r in mixing.mix(d, budget=200_000).collect()}
    out = Counter(r["doc_id"] for r in mixing.mixed(d, budget=200_000).collect() if r["doc_id"] is not None)
    count = Counter(r[0] for r in rows())
    assert out == Counter({i: c * count[i] for (i, _), c in plan.items() if i is not None})


# 3
@pytest.mark.parametrize(("threshold", "how"), [(0.5, {}), (0.8, {}), (1.0, {}), (0.5, {"keep": 1, "window": 1}), (0.8, {"keep": 1, "window": 2})])
def test_lines_against_brute_force(spark, threshold, how):
    rng = random.Random(5)
    base = [[rng.choice(_EN) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 25))] for _ in range(25)]
    data = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(_EN)
            own.append(" ".join(line))
        data.append((i if i % 9 else None, "\n".join(own)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    keyed = {r["text"]: (r["k_id"], r["k_text"]) for r in lines.with_key(d).collect()}
    all_lines = sorted({(*keyed[t], k, frozenset(x.lower().split())) for _, t in data for k, x in enumerate(t.split("\n"))}, key=lambda x: x[:3])
    want = set()
    for j, b in enumerate(all_lines):
        if any(len(a[3] & b[3]) >= threshold * len(a[3] | b[3]) - 1e-12 for a in all_lines[:j]):
            want.add(b[:3])
    got = lines.removed_lines(d, threshold, **how).collect()
    assert {(r["k_id"], r["k_text"], r["line"]) for r in got} == want
    by = {x[:3]: x[3] for x in all_lines}
    for r in got:
        a, b = by[(r["k_id"], r["k_text"], r["line"])], by[(r["m_id"], r["m_text"], r["m_line"])]
        assert len(a & b) >= threshold * len(a | b) - 1e-12 and (r["m_id"], r["m_text"], r["m_line"]) < (r["k_id"], r["k_text"], r["line"])


@pytest.mark.parametrize("tiled", [1, 1 << 40])
def test_tiles_and_single_pairs_find_all_candidates(monkeypatch, tiled):
    rng = random.Random(11)
    base = [sorted({f"w{rng.randint(0, 40)}" for _ in range(rng.randint(4, 30))}) for _ in range(40)]
    texts = [" ".join(rng.sample(b, max(1, len(b) - rng.randint(0, 2))) + ["x"] * rng.randint(0, 1)) for b in base for _ in range(8)]
    monkeypatch.setattr(lines, "TILED", tiled)
    monkeypatch.setattr(lines, "_TILE", (3, 5))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["k_id", "k_text", "text"])
    rank = np.zeros(lines._CELLS, np.uint8)
    packed = pa.Table.from_batches(b for b in lines._signatures(rank, 4, 5, 1)([batch]) if b.column("kind")[0].as_py() == 1)
    every = np.concatenate([lines.Lines(d, o, rank).sig for _, d, o in chunks(pa.array(texts))])
    first: dict[int, tuple[int, set]] = {}
    for i, (s, t) in enumerate(zip(every, texts, strict=True)):
        first.setdefault(int(s), (i, set(t.split())))
    want = {(a, b) for a, (i, x) in first.items() for b, (j, y) in first.items() if j < i and 5 * len(x & y) >= 4 * len(x | y)}
    for only in (None, np.full(1 << 14, 2**64 - 1, np.uint64)):
        got = lines._pairs(lines.unpack(packed, lines._ENTRY), 4, 5, None, None, only, 100)[0]
        pairs = {(int(a), int(b)) for a, x in zip(got["a"].view(np.uint64), got["others"], strict=True) for b in x.values.to_numpy().view(np.uint64)}
        assert want <= pairs and len(want) > 100


def _crowd(n: int) -> list[str]:
    """Lines that are near copies of one, of which some lost too much to be similar to all others."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    base = rng.sample(vocab, 40)
    share = [rng.choice((0.01, 0.03, 0.05, 0.1, 0.15)) for _ in range(n)]
    return [" ".join(w if rng.random() > p else rng.choice(vocab) for w in base) for p in share]


def test_a_crowd_of_near_copies_notes_few_candidates():
    for n in (400, 1600):
        texts = _crowd(n)
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], names=["k_id", "k_text", "text"])
        rank = np.full(lines._CELLS, 5, np.uint8)
        packed = pa.Table.from_batches(b for b in lines._signatures(rank, 4, 5, 1)([batch]) if b.column("kind")[0].as_py() == 1)
        got = lines._pairs(lines.unpack(packed, lines._ENTRY), 4, 5, lines.KEEP, lines.WINDOW, None, 1 << 18)[0]
        has = {int(a): set(x.values.to_numpy().view(np.uint64).tolist()) for a, x in zip(got["a"].view(np.uint64), got["others"], strict=True)}
        more = set(got["a"].view(np.uint64)[got["more"]].tolist())
        assert max(map(len, has.values())) <= 32
        # nothing is lost: an earlier similar set is noted, or the set is known to have more
        first: dict[int, set] = {}
        for t, s in zip(texts, np.concatenate([lines.Lines(d, o, rank).sig for _, d, o in chunks(pa.array(texts))]).tolist(), strict=True):
            if s not in first and n == 400:
                assert s in more or {r for r, y in first.items() if 5 * len(set(t.split()) & y) >= 4 * len(set(t.split()) | y)} <= has.get(s, set())
            first.setdefault(s, set(t.split()))


def test_a_crowd_of_near_copies_against_brute_force(spark):
    texts = _crowd(700)
    sets = [set(t.split()) for t in texts]
    want = {j for j in range(len(sets)) if any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in range(j))}
    got = lines.removed_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["k_id"] for r in got} == want and 0 < len(want) < len(texts) - 1
    assert all(5 * len(sets[r["m_id"]] & sets[r["k_id"]]) >= 4 * len(sets[r["m_id"]] | sets[r["k_id"]]) and r["m_id"] < r["k_id"] for r in got)


def test_noted_candidates_are_sorted_seldom(monkeypatch):
    sorts, best = [], lines.Likeliest.best
    monkeypatch.setattr(lines.Likeliest, "best", lambda self: sorts.append(1) or best(self))
    x, n = lines.Likeliest(4), (1 << 20) + 1
    x.add(np.arange(n, dtype=np.uint64), np.arange(n, dtype=np.uint64), np.zeros(n, np.uint8))
    for k in range(40):
        x.add(np.array([k], np.uint64), np.array([n + k], np.uint64), np.array([1], np.uint8))
    assert len(sorts) == 1 and len(x.best()[0]) == n + 40


def test_lines_are_cut_out(spark):
    d = spark.createDataFrame([(2, "new one here\n\nsame old line of text"), (1, "same old line of text\nother words")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.drop_similar_lines(d, counted=True).collect()}
    assert got == {1: ("same old line of text\nother words", 0), 2: ("new one here\n", 1)}


def test_tokens_over_64_kib_are_told_apart(spark):
    a, b = "b" + "a" * 65535 + "c", "c" + "a" * 65535 + "b"
    d = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.drop_similar_lines(d, counted=True).collect()}
    assert got == {1: (a, 0), 2: (b, 0), 3: ("", 1)}


def test_emptied_documents_go_and_others_are_untouched(spark):
    data = [(1, "one line of words", 99), (2, "one line of words\n \n", 21), (3, "  ", None), (4, "", None), (5, "  ", 7), (6, None, 3), (7, "one line of words\nand more", None)]
    d = spark.createDataFrame(data, "doc_id long, text string, n_chars int")
    out = lines.drop_similar_lines(d, keep_emptied=False, length="n_chars")
    assert out.schema["n_chars"].dataType == d.schema["n_chars"].dataType
    got = {tuple(r) for r in out.collect()}
    assert got == {x for x in data if x[0] not in (2, 7)} | {(7, "and more", 8)}


# 4
def test_fingerprints_against_brute_force(spark):
    data = [(1, "Straße  ﬁx"), (2, "STRASSE fix "), (3, "strasse\nfix"), (4, "other"), (5, None), (6, ""), (7, " "), (None, "other"), (8, None), (4, "other")]
    got = digest.fingerprint(spark.createDataFrame(data, "doc_id long, text string")).collect()
    by = defaultdict(list)
    for i, t in data:
        by[digest.canonical(t) if t is not None else ("null", i)].append(i)
    want = Counter()
    for ids in by.values():
        known = [i for i in ids if i is not None]
        want.update((i, min(known) if known else None, len(ids)) for i in ids)
    assert Counter((r["doc_id"], r["group_id"], r["group_size"]) for r in got) == want
    assert sum(r["keep"] for r in got) == len(by)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {next(r["fingerprint"] for r in got if r["doc_id"] == 1)}


def test_equal_digests_are_compared_byte_by_byte(spark, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh3_128_intdigest", lambda b: 7)
    table = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "k_id": [1, 2], "k_text": [1, 2], "text": ["a", "b"]})
    out = next(digest._digest(None)(iter([table])))
    assert out.column("hi").to_pylist() == [0, 0] and out.column("lo").to_pylist() == [7, 7]
    bits = np.full(1 << 18, 2**64 - 1, np.uint64)
    forms = next(digest._digest(bits)(iter([table]))).column("form").to_pylist()
    assert forms == [b"a", b"b"]


# 5
def test_codes_are_perfect():
    for table, at, _vec, exc in simhash._codes():
        assert np.all([(exc[a:b] == 0).sum() == 1 for a, b in zip(at, at[1:], strict=False)])
        assert table.min() == 0


def test_blocks_within_two_bits_share_an_anchor():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**30, 300)
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(30, flips, replace=False):
                y[i] ^= 1 << int(b)
        (r1, a1), (r2, a2) = simhash.anchors(x), simhash.anchors(y)
        one, two = defaultdict(set), defaultdict(set)
        for r, a, s in ((r1, a1, one), (r2, a2, two)):
            for i, v in zip(r, a, strict=True):
                s[int(i)].add(int(v))
        assert all(one[i] & two[i] for i in range(len(x)))


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2, (60, 256), dtype=np.uint8)
    near = base[rng.integers(0, 60, 200)].copy()
    for row in near:
        row[rng.choice(256, rng.integers(0, 48), replace=False)] ^= 1
    bits = np.unique(np.concatenate([base, near]), axis=0)
    bits[:, 120:128] = 0
    bits = np.unique(bits, axis=0)
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    df = spark.createDataFrame([tuple(map(int, w)) for w in words], "f0 long, f1 long, f2 long, f3 long")
    got = {frozenset((tuple(r[:4]), tuple(r[4:]))) for r in simhash.near_pairs(df).collect()}
    d = (bits[:, None] != bits[None]).astype(int)
    block = np.min([d[:, :, b : b + 30].sum(2) for b in simhash.BLOCKS], axis=0)
    ok = (block <= 2) & (d[:, :, :120].sum(2) <= simhash.COVER_K) & (d[:, :, 128:].sum(2) <= simhash.CONFIRM_K)
    want = {frozenset((tuple(map(int, words[i])), tuple(map(int, words[j])))) for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True)}
    assert got == want and len(want) > 20


def test_large_groups_of_near_prints_give_a_forest():
    rng = np.random.default_rng(7)
    bits = np.repeat(rng.integers(0, 2, (3, 256), dtype=np.uint8), 500, axis=0)
    for row in bits:
        row[rng.choice(120, 12, replace=False)] ^= 1
    bits[:, 120:128] = 0
    words = np.packbits(np.unique(bits, axis=0), axis=1, bitorder="little").view(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(words[:, i])) for i in range(4)], names=["f0", "f1", "f2", "f3"])
    table = pa.Table.from_batches(simhash._scatter(1)([batch]))

    def groups(pairs: pa.Table) -> set[frozenset]:
        of = {}
        for r in zip(*(c.to_pylist() for c in pairs.columns), strict=True):
            both = of.get(r[:4], {r[:4]}) | of.get(r[4:], {r[4:]})
            of.update(dict.fromkeys(both, both))
        return {frozenset(x) for x in of.values()}

    every = simhash._compare(simhash.BLOCK_K, simhash.COVER_K, simhash.CONFIRM_K)(table)
    for tile in (64, 200, 1024):
        few = simhash._compare(simhash.BLOCK_K, simhash.COVER_K, simhash.CONFIRM_K, tile, forest=True)(table)
        assert groups(few) == groups(every) and few.num_rows < len(words) < every.num_rows


def test_components(spark):
    edges = [(i, i + 1) for i in range(50) if i % 10 != 9] + [(100, 200)]
    got = dict(map(tuple, simhash.components(None, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: i - i % 10 for i in range(50) if i % 10} | {200: 100}


def test_anchor_numbers_are_those_of_codewords():
    x = np.random.default_rng(2).integers(0, 2**30, 2000)
    _, a = simhash.anchors(x)
    words = np.unique(a)
    assert len(np.unique(simhash._number(words))) == len(words) and simhash._number(words).max() < 1 << 16


@pytest.mark.parametrize(("words_", "changed", "least"), [(70, 3, 0.85), (120, 6, 0.9), (200, 4, 0.95), (600, 30, 0.95)])
def test_near_copies_are_caught_and_others_kept(spark, words_, changed, least):
    rng = random.Random(8)
    words = [a + b + c for a in "bdfklmnprst" for b in "aeiou" for c in ("n", "r", "st", "ck")]
    data, i = [], 0
    for _ in range(40):
        b = [rng.choice(words) for _ in range(words_)]
        data.append((i, " ".join(b)))
        i += 1
        for _ in range(3):
            c = list(b)
            for k in rng.sample(range(words_), changed):
                c[k] = rng.choice(words)
            data.append((i, " ".join(c)))
            i += 1
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(r["group_id"] // 4 == i // 4 for i, r in got.items())
    assert sum(r["group_size"] > 1 for r in got.values()) >= least * len(got)
    assert sum(r["keep"] for r in got.values()) == len({r["group_id"] for r in got.values()})


# 6
@pytest.mark.parametrize(("dims", "n", "k"), [(64, 300, 10), (16, 500, 7), (70, 120, 200)])
def test_topk_against_brute_force(spark, dims, n, k):
    rng = np.random.default_rng(dims)
    v = rng.normal(size=(n, dims))
    v[10:20] = v[0]
    d = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    b = v > 0
    dist = (b[:, None] != b[None]).sum(2)
    want = {(i, rank, int(j), int(dist[i, j])) for i in range(n) for rank, j in enumerate(sorted((x for x in range(n) if x != i), key=lambda x: (dist[i, x], x))[:k], 1)}
    for how in ({}, {"shard": 100, "block": 90}, {"every": 7, "shard": 64, "block": 5}):
        got = {(r["vec_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in topk.nearest(d, k, **({"every": 1} | how)).collect()}
        assert got == {x for x in want if x[0] % how.get("every", 1) == 0}


# 7
def test_packing_keeps_every_token_once(spark):
    d = docs(spark)
    got = packing.pack(d, seq_len=64, classes=16).collect()
    seqs, covered = defaultdict(list), Counter()
    for r in got:
        seqs[r["seq_id"]].append(r)
        covered[r["doc_id"]] += r["n_tokens"]
    assert covered == Counter({k: v for k, v in sum((Counter({r[0]: len((r[1] or "").split())}) for r in rows()), Counter()).items() if v})
    for s in seqs.values():
        s.sort(key=lambda r: r["slot"])
        assert sum(r["n_tokens"] for r in s) <= 64
        assert [r["at"] for r in s] == [sum(x["n_tokens"] for x in s[:i]) for i in range(len(s))]
    assert sorted(seqs) == list(range(len(seqs)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=16, max_size=16))
def test_patterns_pack_the_histogram(h):
    h = np.array(h)
    got = packing.fit(h, 3)
    used = Counter()
    for p, k in got:
        assert k > 0 and sum(p) <= 16
        used.update({c: k * p.count(c) for c in set(p)})
    assert [used[c] for c in range(1, 17)] == h.tolist()
    # best-fit decreasing as the yardstick
    bins: list[int] = []
    for c in sorted((c for c in range(1, 17) for _ in range(h[c - 1])), reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= c]
        if fits:
            i = min(fits, key=lambda i: bins[i])
            bins[i] -= c
        else:
            bins.append(16 - c)
    assert sum(k for _, k in got) <= len(bins) * 1.1 + 4


def test_nnls():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.normal(size=(8, 5)), rng.normal(size=8)
        x = packing.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-6).all() and np.abs(g * x).max() < 1e-6


# 8
def _codes(texts: list[str]) -> np.ndarray:
    return np.concatenate([hpylm.ngrams(*hpylm.symbols(d, o))[0] for _, d, o in chunks(pa.array(texts, pa.string()))])


def _local_model(texts: list[str], burn_in: int = 1, samples: int = 3) -> hpylm.Lookup:
    code, n = np.unique(_codes(texts), return_counts=True)
    rng = np.random.default_rng(0)
    top = np.full(64**3, 1 / 64)
    tree, driver = hpylm.Tree.start(code, n.astype(np.int64), top, rng), hpylm.Top(rng)
    tops = []
    for r in range(burn_in + samples):
        top = driver.round(tree.top_customers(), 2)
        tree.round(top, 2, rng, r >= burn_in)
        if r >= burn_in:
            tops.append(top)
        if r < 3:
            for k, level in enumerate(tree.levels):
                assert (np.bincount(level.owner, level.size, minlength=len(level.code)) == level.c).all()
                assert (level.t >= 1).all() and (level.t <= level.c).all()
                if k + 1 < len(hpylm.LENGTHS):
                    assert (np.bincount(tree.up[k], level.t, minlength=len(tree.levels[k + 1].code)) == tree.levels[k + 1].c).all()
            again = hpylm.Tree.unpacked(tree.packed())
            assert all((x.t == y.t).all() and (x.c == y.c).all() and (x.code == y.code).all() for x, y in zip(tree.levels, again.levels, strict=True))
            assert all((x.c == driver.levels[k - 1].t.reshape(64, -1).sum(0)).all() for k, x in enumerate(driver.levels) if k)
    return hpylm.Lookup(tree, samples, np.mean(tops, axis=0))


class _Franchise:
    """A hierarchy of restaurants in which customers are seated one by one, table by table."""

    def __init__(self, rng: random.Random):
        self.rng, self.rooms = rng, defaultdict(lambda: defaultdict(list))

    def chance(self, context: tuple, dish: int) -> float:
        base = self.chance(context[1:], dish) if context else 1 / 64
        room, d, theta = self.rooms[context], hpylm.DISCOUNT[len(context)], hpylm.STRENGTH[len(context)]
        c, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        return (max(sum(room[dish]) - d * len(room[dish]), 0) + (theta + d * t) * base) / (theta + c)

    def seat(self, context: tuple, dish: int) -> None:
        base = self.chance(context[1:], dish) if context else 1 / 64
        room, d, theta = self.rooms[context], hpylm.DISCOUNT[len(context)], hpylm.STRENGTH[len(context)]
        t = sum(map(len, room.values()))
        at = self.rng.choices(range(len(room[dish]) + 1), [*(x - d for x in room[dish]), (theta + d * t) * base])[0]
        if at == len(room[dish]):
            room[dish].append(1)
            if context:
                self.seat(context[1:], dish)
        else:
            room[dish][at] += 1

    def leave(self, context: tuple, dish: int) -> None:
        tables = self.rooms[context][dish]
        at = self.rng.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            del tables[at]
            if context:
                self.leave(context[1:], dish)


def test_language_model_against_seating_one_by_one():
    text = "the water of the house and the time of the people with that other water"
    codes = _codes([text])
    customers = [(tuple(int(c) >> 6 * k & 63 for k in range(5, 0, -1)), int(c) & 63) for c in codes]
    f = _Franchise(random.Random(5))
    for context, dish in customers:
        f.seat(context, dish)
    asked = np.concatenate([np.unique(codes), codes[:20] ^ np.uint64(5), codes[:20] ^ np.uint64(7 << 18)])
    want = np.zeros(len(asked))
    sweeps = 260
    for sweep in range(sweeps):
        for context, dish in customers:
            f.leave(context, dish)
            f.seat(context, dish)
        if sweep >= 60:
            want += [f.chance(tuple(int(c) >> 6 * k & 63 for k in range(5, 0, -1)), int(c) & 63) for c in asked]
    want /= sweeps - 60
    got = _local_model([text], burn_in=30, samples=300).probability(asked)
    off = np.abs(np.log(got) - np.log(want))
    assert off.mean() < 0.1 and off.max() < 0.4, (off.mean(), off.max())


def test_language_model_is_a_distribution_and_learns():
    rng = random.Random(1)
    train, held = ([sentence(rng, _EN, 40) for _ in range(n)] for n in (150, 30))
    m = _local_model(train)

    def perplexity(texts):
        return float(np.exp(-np.log(m.probability(_codes(texts))).mean()))

    assert perplexity(held) < 4 < perplexity([sentence(rng, _FR, 40) for _ in range(30)])
    contexts = np.array([0, 1, 2**30 - 1, 12345], np.uint64)
    every = (contexts[:, None] << np.uint64(6) | np.arange(64, dtype=np.uint64)).ravel()
    assert np.allclose(m.probability(every).reshape(4, 64).sum(1), 1, atol=0.02)


def _one_by_one(counts: list[int], base: float, d: float, theta: float, sweeps: int) -> float:
    """Mean number of tables of a restaurant whose every customer is taken out and seated again in turn, by brute force."""
    rng = random.Random(7)
    seats: list[list[int]] = [[] for _ in counts]
    where: list[list[int]] = [[] for _ in counts]  # table of each customer
    tables, seen = 0, []
    for sweep in range(sweeps):
        for k, n in enumerate(counts):
            for i in range(n):
                if sweep:
                    old = where[k][i]
                    seats[k][old] -= 1
                    tables -= not seats[k][old]
                c, t = sum(seats[k]) if not sweep else n - 1, sum(x > 0 for x in seats[k])
                new = (theta + d * tables) * base
                if rng.random() * (c - d * t + new) < new or not c:
                    at = next((j for j, x in enumerate(seats[k]) if not x), len(seats[k]))
                    if at == len(seats[k]):
                        seats[k].append(0)
                    tables += 1
                else:
                    at = rng.choices(range(len(seats[k])), [x - d if x else 0 for x in seats[k]])[0]
                seats[k][at] += 1
                where[k] = where[k] + [at] if not sweep else where[k]
                where[k][i] = at
        if sweep >= sweeps // 3:
            seen.append(tables)
    return sum(seen) / len(seen)


def test_tables_of_large_types_are_those_of_seating_one_by_one():
    counts, base, d, theta = [2500, 400, 30, 5], 0.05, 0.8, 1.0
    level = hpylm.Level(np.arange(4, dtype=np.uint64), d, theta)
    rng, seen = np.random.default_rng(3), []
    level.fill(np.array(counts), np.full(4, base), rng)
    for _ in range(400):
        level.sweep(np.full(4, base), 4, rng)
        seen.append(level.tables[0])
    want = _one_by_one(counts, base, d, theta, 30)
    assert abs(np.mean(seen) - want) < 0.15 * want


@pytest.mark.parametrize("d", [0.5, 0.8])
def test_tables_grow_with_the_count(d):
    n = 3000
    s = np.array([0.0] + [-np.inf] * (n - 1))  # log S(m, t) for t = 1.., by its recursion
    t = np.arange(1, n + 1)
    for m in range(1, n):
        s = np.logaddexp(np.concatenate([[-np.inf], s[:-1]]), s + np.log(np.maximum(m - d * t, 1e-9)))
    for q in (2.0, 30.0, 500.0):
        p = np.exp(s + t * np.log(q) - (s + t * np.log(q)).max())
        p /= p.sum()
        mean, sd = (p * t).sum(), np.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
        got = hpylm.draw_tables(np.full(20000, n), np.full(20000, q), d, np.random.default_rng(1))
        assert abs(got.mean() - mean) < 0.1 * sd and abs(got.std() - sd) < 0.1 * sd


def test_scores_against_one_model_in_one_place(spark):
    d = docs(spark)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_symbols"])
    runs = []
    for how in ({}, {"block_bytes": 3000, "salt_bytes": 20_000}):
        blocks = hpylm.blocked(d, parts=3, **how)
        assert blocks.texts.select("block").distinct().count() > 3 * bool(how) and (blocks.salts > 1) == bool(how)
        model = hpylm.fit(blocks, burn_in=1, samples=2, moves=1)
        runs.append(sorted(hpylm.score(blocks, model).collect(), key=key))
    assert runs[0] == runs[1]
    # the same model, looked up text by text
    look = {r["part"]: hpylm.Lookup(hpylm.Tree.unpacked(bytes(r["state"])), 2, model.top) for r in model.state.collect()}
    want = Counter()
    for r in rows():
        c = _codes([r[1]])
        part = hpylm.part_of(c, 3)
        lp = sum(float(np.log(look[p].probability(c[part == p])).sum()) for p in look) if len(c) else 0.0
        want[(r[0], len(r[1] or ""), round(lp, 1))] += 1
    assert Counter((r["doc_id"], r["n_symbols"], round(r["log_prob"], 1)) for r in runs[0]) == want
    by = {r["doc_id"]: r for r in runs[0]}
    assert by[103]["perplexity"] is None and by[103]["n_symbols"] == 0 and by[102]["perplexity"] is None
    assert by[107]["n_symbols"] == 4 and abs(by[107]["perplexity"] - math.exp(-by[107]["log_prob"] / 4)) < 1e-3


# 9
def test_chats_against_brute_force(spark):
    rng = random.Random(2)
    data, logs = [], {}
    for c in range(60):
        turns = [("user", rng.choice("ab")) if t % 2 == 0 else ("assistant", rng.choice("ab")) for t in range(rng.randint(1, 5))]
        logs[c] = turns
        data += [(c, t, *x) for t, x in enumerate(turns)]
    got = {r["conv_id"] for r in chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    want = {c for c, t in logs.items() if not any((len(o) > len(t) and o[: len(t)] == t) or (o == t and k < c) for k, o in logs.items())}
    assert got == want


# 10
def test_place_against_brute_force():
    rng = np.random.default_rng(3)
    needs = rng.random((80, 3)) * 0.2
    shards = 9
    residual = [[1.0] * 3 for _ in range(shards)]
    want = [0] * len(needs)
    for i in sorted(range(len(needs)), key=lambda i: (-needs[i].max(), i)):
        fit = [s for s in range(shards) if all(residual[s][d] - needs[i][d] >= -1e-12 for d in range(3))]
        if fit:
            best = max(fit, key=lambda s: (sum(residual[s][d] * needs[i][d] for d in range(3)), -s))
        else:
            best = max(range(shards), key=lambda s: (min(residual[s][d] - needs[i][d] for d in range(3)), -s))
        for d in range(3):
            residual[best][d] -= needs[i][d]
        want[i] = best
    assert sharding.place(needs, shards).tolist() == want


def test_place_looks_at_all_of_many_shards():
    shards = 1100
    needs = np.random.default_rng(5).random((1500, 3)) * 0.9
    residual, want = np.ones((shards, 3)), np.zeros(len(needs), int)
    for i in sorted(range(len(needs)), key=lambda i: (-needs[i].max(), i)):
        fit = (residual - needs[i] >= -1e-12).all(1)
        best = np.argmax(np.where(fit, residual @ needs[i], -1)) if fit.any() else np.argmax((residual - needs[i]).min(1))
        residual[best] -= needs[i]
        want[i] = best
    assert sharding.place(needs, shards).tolist() == want.tolist()


def test_groups_that_fit_a_shard_stay_whole(spark):
    sizes = {"a": 90, "b": 60, "c": 45, "d": 30, **{f"s{i}": 1 for i in range(75)}}  # documents of 100 bytes, 3 shards of 100
    data = [(f"{k}", i) for k, n in sizes.items() for i in range(n)]
    d = spark.createDataFrame([(i, "x" * 100, k, "en") for i, (k, _) in enumerate(data)], "doc_id long, text string, source string, lang string")
    at = defaultdict(set)
    filled = Counter()
    for r in sharding.shard(d, target_bytes=10_000).collect():
        at[data[r["doc_id"]][0]].add(r["shard"])
        filled[r["shard"]] += 1
    assert all(len(x) == 1 for x in at.values())
    assert sorted(filled.values()) == [100, 100, 100]


def test_shards_are_balanced(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = sharding.shard(d, target_bytes=200_000)
    sums = d.join(placed, "doc_id").groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in sums) == d.count()
    mean = sum(r["b"] for r in sums) / len(sums)
    assert max(r["b"] for r in sums) < 1.35 * mean
