"""Operator 5, SimHash near-duplicates by anchor-point covering.

Two SimHashes a text, both over its distinct lower-case words: `cover` (120 bits, a word of tf n weighs n**0.85) and
`confirm` (128 bits, n**0.5), whose flatter weights keep chance neighbours far apart. BLOCKS are six blocks of 30 bits,
four of cover and two of confirm. A pair is a near copy when it differs in at most BLOCK_K bits of some block, in at
most COVER_K of cover and in at most CONFIRM_K of confirm.

Covering: each block is a word of the product of the perfect binary Golay code [23,12] (radius 3) and the perfect
Hamming code [7,4] (radius 1); its codewords are the anchors, 65,536 a block. Of two blocks within 2 bits some point z
lies within 1 of both. The anchor covering z is within (covering radius + 1) of both, so that every fingerprint is
replicated to the anchors within covering radius plus half the block's threshold (about 8 a block, where the radius is
spent by factor code), and each near copy meets at an anchor. Comparison is per anchor; the search is exact.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlane.llm.common import U64, bitmap, chunks, materialize, may_hold, mix, partitions, tokens, with_key, with_row

BLOCKS, BLOCK_BITS = (0, 30, 60, 90, 128, 158), 30  # where each block begins
BLOCK_K, COVER_K, CONFIRM_K = 2, 19, 24
PART_BYTES = 32 << 20  # of replicated fingerprints in a partition
_FEATURES = 1 << 15


# codes
def _syndromes(n: int, gen: int, deg: int) -> np.ndarray:
    """Remainder of x**i modulo the generator polynomial, for every bit i of an n-bit word."""
    out, r = [], 1
    for _ in range(n):
        out.append(r)
        r <<= 1
        if r >> deg & 1:
            r ^= gen
    return np.array(out, np.int64)


@cache
def _coset(n: int, gen: int, deg: int, weight: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Table of byte-free syndromes of all words, and for each syndrome its (vector, weight) up to weight."""
    s = _syndromes(n, gen, deg)
    table = np.zeros(1, np.int16)
    for i in range(n):
        table = np.concatenate([table, table ^ np.int16(s[i])])
    vectors: list[list[tuple[int, int]]] = [[] for _ in range(1 << deg)]
    for w in range(weight + 1):
        for bits in combinations(range(n), w):
            v, x = 0, 0
            for b in bits:
                v |= 1 << b
                x ^= int(s[b])
            vectors[x].append((v, w))
    return table, vectors


@cache
def _codes(extra: int = 1):
    """For the two factor codes: syndrome table and (offsets, vectors, excess over the covering radius)."""
    made = []
    for n, gen, deg, radius in ((23, 0b101011100011, 11, 3), (7, 0b1011, 3, 1)):
        table, vectors = _coset(n, gen, deg, radius + extra)
        flat = [(v, max(0, w - radius)) for c in vectors for v, w in c]
        made.append(
            (
                table,
                np.cumsum([0, *(len(c) for c in vectors)]),
                np.array([v for v, _ in flat], np.int64),
                np.array([e for _, e in flat], np.int8),
            )
        )
    return made


def anchors(block: np.ndarray, extra: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within covering radius + extra of a 30-bit block, the excess summed over both codes."""
    parts = []
    for (table, at, vec, exc), word in zip(_codes(extra), (block & (2**23 - 1), block >> 23), strict=True):
        s = table[word].astype(np.int64)
        n = at[s + 1] - at[s]
        rows = np.repeat(np.arange(len(word)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[s], n)
        parts.append((rows, word[rows] ^ vec[k], exc[k], n))
    (r1, a1, e1, n1), (r2, a2, e2, n2) = parts
    # every first-code anchor of a row with every second-code anchor of it
    m = n2[r1]
    left = np.repeat(np.arange(len(r1)), m)
    first2 = np.cumsum(n2) - n2
    right = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first2[r1], m)
    ok = e1[left] + e2[right] <= extra
    left, right = left[ok], right[ok]
    return r1[left], a1[left] | (a2[right] << 23)


# fingerprints
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=U64)


def _fingerprint(h: np.ndarray) -> np.ndarray | None:
    """Four words: cover (bits 0-119), confirm (bits 128-255), of a text's token hashes."""
    if not len(h):
        return None
    word, n = np.unique(h, return_counts=True)
    n = n.astype(np.float32)
    weight = np.stack([n**0.85, n**0.5])
    total = np.zeros((2, 256), np.float32)
    for a in range(0, len(word), _FEATURES):
        w = word[a : a + _FEATURES]
        bits = np.unpackbits(mix(w[:, None] ^ _SEEDS).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
        total += weight[:, a : a + _FEATURES] @ bits
    half = weight.sum(1, keepdims=True) / 2
    up = total > half
    return np.packbits(np.concatenate([up[0, :128], up[1, 128:]]), bitorder="little").view(U64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("k_id", pa.int64()), ("k_text", pa.int64()), *((f"f{i}", pa.int64()) for i in range(4))])


def _sketch(batches):
    for batch in batches:
        n = batch.num_rows
        fp, has = np.zeros((n, 4), U64), np.zeros(n, bool)
        for row, data, offs in chunks(batch.column("text")):
            start, h = tokens(data, offs, words=True)
            cut = np.searchsorted(start, offs)
            for i in range(len(offs) - 1):
                f = _fingerprint(h[cut[i] : cut[i + 1]])
                if f is not None:
                    fp[row + i], has[row + i] = f, True
        words = fp.view(np.int64)
        words[:, 1] &= (1 << 56) - 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("k_id"), batch.column("k_text"), *(pa.array(np.ascontiguousarray(words[:, i]), mask=~has) for i in range(4))],
            schema=_SKETCH,
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row key and the four words of the fingerprint; null words for a text without words."""
    return with_key(docs).mapInArrow(_sketch, "doc_id long, k_id long, k_text long, f0 long, f1 long, f2 long, f3 long")


# search
_ROW = np.dtype([("key", "<u4"), ("f0", "<u8"), ("f1", "<u8"), ("f2", "<u8"), ("f3", "<u8")])


def _block(f: np.ndarray, b: int) -> np.ndarray:
    """Block b of fingerprints (rows x 4 words)."""
    w, at = divmod(BLOCKS[b], 64)
    word = f[:, w] >> U64(at)
    if at > 64 - BLOCK_BITS:
        word = word | f[:, w + 1] << U64(64 - at)
    return (word & U64(2**BLOCK_BITS - 1)).astype(np.int64)


def _number(anchor: np.ndarray) -> np.ndarray:
    """A codeword's 16 message bits: 12 of the Golay code, 4 of the Hamming code."""
    return (anchor & (2**23 - 1)) >> 11 | anchor >> 26 << 12


def _scatter(parts: int):
    def run(batches):
        for batch in batches:
            f = np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(U64) for i in range(4)], axis=1)
            for a in range(0, len(f), 4096):
                g = f[a : a + 4096]
                out = []
                for b in range(len(BLOCKS)):
                    row, anchor = anchors(_block(g, b))
                    rec = np.empty(len(row), _ROW)
                    rec["key"] = _number(anchor) | b << 16
                    for i in range(4):
                        rec[f"f{i}"] = g[row, i]
                    out.append(rec)
                rec = np.concatenate(out)
                part = (mix(rec["key"].astype(U64)) % U64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                rec, part = rec[order], part[order]
                ids, first = np.unique(part, return_index=True)
                blobs = [rec[i:j].tobytes() for i, j in zip(first, [*first[1:], len(rec)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "rows"])

    return run


_EDGES = pa.schema([(f"{s}{i}", pa.int64()) for s in "ab" for i in range(4)])


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The root of each of x; parents of x become roots."""
    up = parent[x]
    while True:
        over = parent[up]
        if (over == up).all():
            break
        up = over
    parent[x] = up
    return up


def _union(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the trees of x and y pair by pair; a root hangs from a smaller one."""
    while len(x):
        x, y = _root(parent, x), _root(parent, y)
        apart = x != y
        x, y = x[apart], y[apart]
        parent[np.maximum(x, y)] = np.minimum(x, y)


def _distinct(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first of their value, and each row's number among them."""
    h = f[:, 0].copy()
    for i in range(1, 4):
        h = mix(h) ^ f[:, i]
    order = np.argsort(h)
    g = f[order]
    new = np.append(True, (g[1:] != g[:-1]).any(axis=1))
    number = np.empty(len(f), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _compare(block_k: int, cover_k: int, confirm_k: int, tile: int = 1024, forest: bool = False):
    """All near pairs of a partition, or with forest as few that connect the same fingerprints: at most one for each
    fingerprint, while pairs are n * n of a group of near copies; those that are connected already are not compared."""

    def run(table: pa.Table) -> pa.Table:
        rec = np.concatenate([np.frombuffer(x, _ROW) for x in table.column("rows").to_pylist()])
        rec = rec[np.argsort(rec["key"], kind="stable")]
        f = np.stack([rec[f"f{i}"] for i in range(4)], axis=1)
        cut = np.flatnonzero(np.diff(rec["key"], prepend=rec["key"][:1] + np.uint32(1)))
        left, right = [], []
        if forest:
            one, node = _distinct(f)
            parent = np.arange(len(one))
        for a, b in zip(cut, [*cut[1:], len(rec)], strict=True):
            if b - a < 2:
                continue
            word = _block(f[a:b], int(rec["key"][a]) >> 16).astype(np.uint32)
            for i in range(0, b - a, tile):
                for j in range(i, b - a, tile):
                    near = np.bitwise_count(word[i : i + tile, None] ^ word[None, j : j + tile]) <= block_k
                    if forest and near.size > 1 << 14:
                        near &= _root(parent, node[a + i : min(a + i + tile, b)])[:, None] != _root(parent, node[a + j : min(a + j + tile, b)])
                    p, q = np.nonzero(near)
                    if i == j:
                        p, q = p[p < q], q[p < q]
                    for k in range(0, len(p), 1 << 16 if forest else 1 << 18):
                        x, y = (a + at + r[k : k + (1 << 16 if forest else 1 << 18)] for at, r in ((i, p), (j, q)))
                        if forest:
                            open_ = _root(parent, node[x]) != _root(parent, node[y])
                            x, y = x[open_], y[open_]
                        d = np.bitwise_count(f[x] ^ f[y])
                        ok = (d[:, 0] + d[:, 1] <= cover_k) & (d[:, 2] + d[:, 3] <= confirm_k)
                        if forest:
                            _union(parent, node[x[ok]], node[y[ok]])
                        else:
                            left.append(f[x[ok]])
                            right.append(f[y[ok]])
        if forest:
            root = _root(parent, np.arange(len(parent)))
            tied = np.flatnonzero(root != np.arange(len(parent)))
            pairs = np.concatenate([f[one[root[tied]]], f[one[tied]]], axis=1)
        else:
            pairs = np.zeros((0, 8), U64)
            if left:
                pairs = np.unique(np.concatenate([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        return pa.Table.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in range(8)], schema=_EDGES)

    return run


def near_pairs(prints: DataFrame, block_k: int = BLOCK_K, cover_k: int = COVER_K, confirm_k: int = CONFIRM_K, forest: bool = False) -> DataFrame:
    """Pairs of distinct fingerprints within all thresholds, from a frame of distinct f0..f3 without nulls; a pair may come
    more than once. Partitions follow the number of fingerprints. With forest only pairs (a representative and a fingerprint
    connected to it) that give the same connected groups."""
    if block_k > 2:
        raise ValueError("anchors within covering radius + 1 cover 2 bits of a block")
    parts = max(partitions(prints.sparkSession), -(-prints.count() * len(BLOCKS) * 8 * _ROW.itemsize // PART_BYTES))
    schema = ", ".join(f"{s}{i} long" for s in "ab" for i in range(4))
    return (
        prints.select("f0", "f1", "f2", "f3")
        .mapInArrow(_scatter(parts), "part int, rows binary")
        .groupBy("part")
        .applyInArrow(_compare(block_k, cover_k, confirm_k, forest=forest), schema)
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node that has an edge (node, root), by alternating large and small
    stars; each round is written to the shared folder, so that a lost executor costs one round at most."""
    e = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, group_id (smallest doc_id of its group), group_size and keep.

    A group is a connected component of near copies; exactly one row of it has keep = true, the one with
    the smallest doc_id (null comes last), of equal ones the one with the least hash of its text, any of them where whole
    rows repeat. A text that is null, empty or has no words is a group of its own and is kept; group_id is its doc_id.
    A null doc_id stays null and its row is grouped by its text as any other. Texts are whole, however long. Other columns
    of docs are ignored. An empty table gives none.
    """
    return _decide(docs).select("doc_id", "group_id", "group_size", "keep")


def _decide(docs: DataFrame) -> DataFrame:
    fp = materialize(fingerprints(docs), "prints")
    node = F.xxhash64("f0", "f1", "f2", "f3")
    prints = materialize(fp.where("f0 is not null").select("f0", "f1", "f2", "f3").distinct(), "distinct")
    pairs = near_pairs(prints, forest=True).select(
        F.xxhash64("a0", "a1", "a2", "a3").alias("a"), F.xxhash64("b0", "b1", "b2", "b3").alias("b")
    )
    roots = components(prints, pairs)
    own = F.xxhash64("k_id", "k_text", F.lit("alone"))
    rows = fp.withColumn("node", F.when(F.col("f0").isNull(), own).otherwise(node)).join(roots, "node", "left")
    grp = F.coalesce("root", "node")
    rows = rows.select("doc_id", "k_id", "k_text", grp.alias("g"), F.col("f0").isNull().alias("blank"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("k_text")]
    # one row of each group by aggregation, so that a large group never has to be sorted in one task
    first = rows.where("not blank").groupBy("g").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), "k_text")).alias("m"), F.count("*").alias("group_size")
    )
    kept = rows.join(first, "g", "left")
    lead = F.col("m.i").eqNullSafe(F.col("doc_id")) & (F.col("m.k_text") == F.col("k_text"))
    nth = F.row_number().over(Window.partitionBy("g", "k_id", "k_text").orderBy(*order))
    return kept.withColumn("nth", nth).select(
        "doc_id",
        "k_id",
        "k_text",
        F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("m.i")).alias("group_id"),
        F.when(F.col("blank"), F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"),
        F.when(F.col("blank"), F.lit(True)).otherwise(lead & (F.col("nth") == 1)).alias("keep"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of near copies; its columns and types stay.

    Repeated rows of one document (same doc_id and text) are copies of each other, of which one stays. Which row of a group
    stays, and what becomes of nulls and of texts without words, is as near_duplicates() says. An empty table gives none.
    """
    d = materialize(_decide(docs), "groups")
    key = ["k_id", "k_text"]
    stays = d.groupBy(*key).agg(F.max("keep").alias("keep"), F.sum(F.col("keep").cast("int")).alias("kept"), F.count("*").alias("n"))
    odd = materialize(stays.where("not keep or n > kept").select(*key, "keep"), "odd")
    # only rows that may go are shuffled: a bitmap lets the others past the joins
    touched = may_hold(bitmap(odd.select("k_text").distinct(), "k_text"))
    keyed = with_row(docs).withColumn("touched", touched(F.col("k_text")))
    met = keyed.where("touched").join(odd, key, "left")
    once = met.where("keep").dropDuplicates(key)
    return keyed.where("not touched").select("row").unionByName(met.where("keep is null").select("row")).unionByName(once.select("row")).select("row.*")
