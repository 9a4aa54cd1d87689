"""Operator 7, best-fit packing: length patterns fitted by non-negative least squares.

Documents are cut into pieces of at most SEQ_LEN tokens; a full piece is a sequence of its own. The others
fall into CLASSES length classes (rounded up). Patterns are all multisets of up to DEPTH classes that fill a
sequence. Repeat counts x >= 0 minimise |A x - histogram| and are rounded down, never beyond what the histogram
has; what they leave is packed best-fit, largest first, by class and to any number of documents a sequence.

All of that happens on a histogram of CLASSES numbers, of the same size for every corpus. Documents are
assigned by their rank within their class, from window ranks in shards of bounded size plus shard offsets.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlane.llm.common import materialize
from siftlane.llm.mixing import token_count

SEQ_LEN, CLASSES, DEPTH = 2048, 64, 4
SHARD_ROWS = 1 << 16


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-10 * max(1.0, np.abs(a.T @ b).max())
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(w.argmax())
        if w[j] <= tol:
            break
        passive[j] = True
        while passive.any():
            p = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[p] = z
                break
            bad = z <= 0
            x[p] += (x[p][bad] / np.maximum(x[p][bad] - z[bad], 1e-300)).min() * (z - x[p])
            passive[p[x[p] <= 1e-12]] = False
            x[~passive] = 0
    return x


def patterns(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of 1..depth classes (1-based sizes) whose sum is classes."""
    return [c for d in range(1, depth + 1) for h in combinations_with_replacement(range(1, classes + 1), d - 1) if sum(h) < classes for c in [(*h, classes - sum(h))] if d == 1 or c[-1] >= c[-2]]


def fit(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that pack exactly the histogram of classes 1..n."""
    n = len(histogram)
    left = np.asarray(histogram, np.int64).copy()
    if not left.sum():
        return []
    pats = patterns(n, depth)
    a = np.zeros((n, len(pats)))
    for i, p in enumerate(pats):
        for c in p:
            a[c - 1, i] += 1
    scale = float(left.sum())
    x = nnls(a, left / scale) * scale
    out = []
    for i in np.argsort(-x, kind="stable"):
        need = a[:, i].astype(np.int64)
        k = int(min(np.floor(x[i] + 1e-6), (left[need > 0] // need[need > 0]).min()))
        if k > 0:
            left -= k * need
            out.append((pats[i], k))
    # residuals: the largest class left, then again and again the largest that fits; repeated while counts last
    while left.any():
        room, pattern, rest = n, [], left.copy()
        while True:
            fit_ = np.flatnonzero(rest[:room])
            if not len(fit_):
                break
            c = int(fit_[-1])
            pattern.append(c + 1)
            rest[c] -= 1
            room -= c + 1
        need = np.bincount(np.array(pattern) - 1, minlength=n)
        k = int((left[need > 0] // need[need > 0]).min())
        left -= k * need
        out.append((tuple(pattern), k))
    return out


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, classes: int = CLASSES, depth: int = DEPTH) -> DataFrame:
    """One row a piece: seq_id, slot (place in its sequence), doc_id, piece, first_token and n_tokens in the document,
    and at, where it begins in the sequence.

    Tokens are split by ASCII white space. Null and empty texts have none and give no piece. Repeated rows and
    null doc_ids are packed as any other, each row once. Ties of length go by doc_id (null first). Other columns
    are ignored. An empty table gives none.
    """
    if seq_len % classes:
        raise ValueError("seq_len must be a multiple of classes")
    unit = seq_len // classes
    # row_number below tells repeated rows apart: the sizes are written once, so that every pass sees the same
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), token_count().alias("n")).select("doc_id", "n", F.xxhash64("text").alias("h")).where("n > 0"), "sizes")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / seq_len)))
    pieces = sizes.select("doc_id", "h", "n", cut.alias("piece")).select(
        "doc_id", "h", "piece", (F.col("piece") * seq_len).alias("first_token"), F.least(F.lit(seq_len), F.col("n") - F.col("piece") * seq_len).alias("n_tokens")
    )
    pieces = pieces.withColumn("class", F.ceil(F.col("n_tokens") / unit).cast("int"))
    total = sizes.count()
    shards = max(1, -(-total // SHARD_ROWS))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(shards)))
    local = F.row_number().over(Window.partitionBy("class", "shard").orderBy("doc_id", "h", "piece"))
    ranked = materialize(pieces.withColumn("local", local).drop("h"), "ranked")
    counts = ranked.groupBy("class", "shard").agg(F.count("*").alias("c"))
    offset = F.coalesce(F.sum("c").over(Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.join(counts.select("class", "shard", offset.alias("offset")), ["class", "shard"]).withColumn("rank", F.col("offset") + F.col("local") - 1)
    histogram = np.zeros(classes, np.int64)
    for r in ranked.groupBy("class").count().collect():
        histogram[r["class"] - 1] = r["count"]
    # for each class, where each slot's ranks begin: pattern k with repeats m takes m ranks per slot
    used = np.zeros(classes, np.int64)
    slots, seq = [], 0
    for pattern, m in fit(histogram, depth):
        for slot, c in enumerate(pattern):
            slots.append((c, int(used[c - 1]), int(used[c - 1]) + m, seq, slot))
            used[c - 1] += m
        seq += m
    spark = docs.sparkSession
    table = spark.createDataFrame(slots, "class int, lo long, hi long, base long, slot int")
    by_class = table.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "base", "slot"))).alias("slots"))
    # at most a few hundred slots, bounded by classes: one row a class
    hit = F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
    placed = ranked.join(F.broadcast(by_class), "class").withColumn("s", hit)
    placed = placed.select((F.col("s.base") + F.col("rank") - F.col("s.lo")).alias("seq_id"), F.col("s.slot").alias("slot"), "doc_id", "piece", "first_token", "n_tokens")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("seq_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("at", before)
