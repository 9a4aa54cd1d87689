"""Operator 6, exact top-k search in binary codes by incremental multi-index hashing.

A code is the signs of a vector. Its bits are cut into segments of about log2(n) bits, each indexed by its
value. A query looks up the segment values at Hamming radius 0, then 1, and so on, a segment at a time, and
verifies what it meets. When all segments are done to radius r and the first a of them to r + 1, every code
within m * (r + 1) + a - 1 has been met: a query ends when its k-th verified distance is within that.

Queries are the vectors whose vec_id is divisible by EVERY, against all vectors. The codes are cut by hash into shards
of about SHARD; a shard's index is built once and the queries stream through it in blocks of BLOCK; the k best of all
shards are the k best. Equal codes of a shard are one entry with their k + 1 smallest ids, of which no more can be
among the k best, so that no number of copies makes a bucket large. Nothing is broadcast.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlane.llm.common import U64, materialize

K, EVERY = 10, 100
SHARD, BLOCK = 1 << 20, 1 << 10
_STEP = 1 << 19


def _bits(codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits lo..hi-1 of codes (rows x words of 64 bits)."""
    w, s = divmod(lo, 64)
    v = codes[:, w] >> U64(s)
    if hi > (w + 1) * 64:
        v = v | codes[:, w + 1] << U64(64 - s)
    return (v & U64((1 << (hi - lo)) - 1)).astype(np.int64)


class Index:
    """Segments of codes (rows x words of 64 bits) with their ids, for the k nearest."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, bits: int, k: int):
        o = np.lexsort((ids, *codes.T))
        codes, ids = codes[o], ids[o]
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]).any(1)))[: len(codes)]
        rank = np.arange(len(codes)) - np.repeat(first, np.diff(first, append=len(codes)))
        # of equal codes only the k + 1 smallest ids can be among the k nearest of any query
        self.codes, self.ids, self.bits, self.k = codes[rank <= k], ids[rank <= k], bits, k
        n = len(self.codes)
        width = int(np.clip(np.log2(max(n, 2)) - 2, 4, 20))
        self.m = max(1, min(bits, -(-bits // width)))
        self.edges = [bits * i // self.m for i in range(self.m + 1)]
        spans = list(zip(self.edges, self.edges[1:], strict=False))
        self.seg = [_bits(self.codes, a, b) for a, b in spans]
        self.order = [np.argsort(c, kind="stable") for c in self.seg]
        self.start = [np.searchsorted(c[o], np.arange((1 << (b - a)) + 1)) for c, o, (a, b) in zip(self.seg, self.order, spans, strict=True)]

    def search(self, queries: np.ndarray, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, distance) of the k nearest codes of each query by (distance, id), itself (its id) left out."""
        codes, ids, bits, k, m, edges = self.codes, self.ids, self.bits, self.k, self.m, self.edges
        none = np.zeros(0, np.int64)
        if not len(queries) or not len(codes):
            return none, none, none
        q_seg = [_bits(queries, a, b) for a, b in zip(edges, edges[1:], strict=False)]
        k_here = min(k, len(codes))
        found = np.zeros((len(queries), bits + 2), np.int64)  # verified codes by distance
        limit = np.full(len(queries), bits)
        kept: list[tuple[np.ndarray, ...]] = []
        live = np.arange(len(queries))
        done = np.full(m, -1)  # radius searched, by segment
        for r in range(max(b - a for a, b in zip(edges, edges[1:], strict=False)) + 1):
            for s in range(m):
                masks = np.array([sum(1 << i for i in c) for c in combinations(range(edges[s + 1] - edges[s]), r)], np.int64)
                for q, x, d in self._meet(s, masks, live, q_seg, queries):
                    ok = (d <= limit[q]) & (ids[x] != query_ids[q])
                    q, x, d = q[ok], x[ok], d[ok]
                    new = np.ones(len(q), bool)
                    for t in range(m):  # met before in a segment already searched that far?
                        if done[t] >= 0:
                            new &= np.bitwise_count(q_seg[t][q] ^ self.seg[t][x]) > done[t]
                    q, x, d = q[new], x[new], d[new]
                    np.add.at(found, (q, d), 1)
                    kept.append((q, x, d))
                done[s] = r
                covered = int((done + 1).sum()) - 1
                enough = np.cumsum(found[live], axis=1) >= k_here
                limit[live] = np.where(enough.any(1), enough.argmax(1), bits)
                live = live[limit[live] > covered]
                if not len(live):
                    break
            if not len(live):
                break
        q, x, d = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (none, none, none)
        near = d <= limit[q]
        q, x, d = q[near], x[near], d[near]
        o = np.lexsort((ids[x], d, q))
        q, x, d = q[o], x[o], d[o]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        return q[top], ids[x[top]], d[top]

    def _meet(self, s: int, masks: np.ndarray, live: np.ndarray, q_seg: list[np.ndarray], queries: np.ndarray):
        """(query, code, distance) of all codes whose segment s is a live query's up to one of the masks, _STEP at a time."""
        per = max(1, 65536 // max(1, len(masks)))
        for a in range(0, len(live) if len(masks) else 0, per):
            qs = live[a : a + per]
            value = (q_seg[s][qs][:, None] ^ masks[None, :]).ravel()
            lo, n = self.start[s][value], self.start[s][value + 1] - self.start[s][value]
            some = n > 0
            lo, n, owner = lo[some], n[some], np.repeat(qs, len(masks))[some]
            ends = np.cumsum(n)
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + _STEP, side="right")))
                c = n[i:j]
                q = np.repeat(owner[i:j], c)
                x = self.order[s][np.repeat(lo[i:j], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
                yield q, x, np.bitwise_count(queries[q] ^ self.codes[x]).sum(1, dtype=np.int64)
                i = j


def _or_sign(word: int):
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return lambda acc, i: acc.bitwiseOR(F.when((F.get("embedding", i + word * 64) > 0) & ~F.isnan(F.get("embedding", i + word * 64)), F.call_function("shiftleft", one, i)).otherwise(zero))


def codes(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and words (array of longs, the signs; over zero is 1, a NaN is not) of the vectors that have dims numbers, none of them null."""
    ok = vectors.where((F.size("embedding") == dims) & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda v: v.isNull()))
    words = [
        F.aggregate(
            F.sequence(F.lit(0), F.lit(min(64, dims - w * 64) - 1)),
            F.lit(0).cast("long"),
            _or_sign(w),
        )
        for w in range(-(-dims // 64))
    ]
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.array(*words).alias("words"))


_NEAR = pa.schema([("vec_id", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.int64())])


def _stream(bits: int, k: int):
    """Over rows (shard, kind, ids, words) in the order of shard and kind: codes (0) make a shard's index, blocks of
    queries (1) go through it."""

    def run(batches):
        at, held, index = None, [], None
        for batch in batches:
            shard, kind, ids, words = (batch.column(i) for i in range(4))
            shard, kind = shard.to_numpy(), kind.to_numpy()
            for i, j in _stretches(shard, kind):
                if shard[i] != at:
                    at, held, index = shard[i], [], None
                own, code = ids.slice(i, j - i), words.slice(i, j - i)
                if kind[i] == 0:
                    held.append((own.flatten().to_numpy(), code.flatten().to_numpy()))
                    continue
                if index is None and held:
                    own_ids, own_words = (np.concatenate(x) for x in zip(*held, strict=True))
                    index, held = Index(own_words.view(U64).reshape(len(own_ids), -1), own_ids, bits, k), []
                for r in range(j - i if index else 0):
                    q_ids = own[r].values.to_numpy()
                    q, neighbor, d = index.search(code[r].values.to_numpy().view(U64).reshape(len(q_ids), -1), q_ids)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(neighbor), pa.array(d)], schema=_NEAR)

    return run


def _stretches(*columns: np.ndarray):
    new = np.any([np.diff(c, prepend=c[:1] + 1) != 0 for c in columns], axis=0)
    first = np.flatnonzero(new)
    return zip(first, [*first[1:], len(columns[0])], strict=True)


def nearest(vectors: DataFrame, k: int = K, dims: int | None = None, every: int = EVERY, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """vec_id, rank (from 1), neighbor_id and distance: the k nearest codes, by distance and then id, of each vector
    whose vec_id is divisible by every.

    dims: length of the vectors, the most frequent one of the table unless given (of equally frequent ones the
    longest). A vector that is null, has a null in it or another length, or has no vec_id is neither query nor result.
    A NaN counts as not over zero. Rows that repeat a vec_id are one vector, the one with the smallest code. With fewer
    than k others, all of them come. Other columns are ignored. An empty table gives none.
    """
    if dims is None:
        size = F.size("embedding").alias("n")
        row = vectors.where("embedding is not null").groupBy(size).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
        dims = row["n"] if row else 1
    dims = max(1, dims)
    table = materialize(codes(vectors, dims).groupBy("vec_id").agg(F.min("words").alias("words")), "codes")
    shards = max(1, -(-table.count() // shard))
    h = F.xxhash64("vec_id")
    asked = table.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // block))
    packed = asked.groupBy(F.pmod(h, F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "words")).alias("q"))
    q = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("q.vec_id").alias("ids"), F.flatten("q.words").alias("words"))
    c = table.select(F.pmod(F.xxhash64(h), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.array("vec_id").alias("ids"), "words")
    near = c.unionByName(q).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_stream(dims, k), "vec_id long, neighbor_id long, distance long")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbor_id")).cast("long")
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "distance")


ORACLE = """
WITH d AS (SELECT len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, n DESC LIMIT 1
), c AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS b FROM embeddings, d WHERE len(embedding) = n
), p AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, list_sum(list_transform(list_zip(a.b, b.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::BIGINT AS distance
  FROM c a JOIN c b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id)::BIGINT AS rank, neighbor_id, distance
FROM p QUALIFY rank <= 10
"""
