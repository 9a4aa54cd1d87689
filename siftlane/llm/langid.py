"""Operator 1, language identification by nearest centroid.

A text is the TF-IDF vector of its letters' byte 2- and 3-grams: lower case, every run of other ASCII
bytes one space, counted in 8,192 hashed cells, (1 + ln tf) * idf, length 1. Each language has several
centroids, from spherical k-means over labelled texts. The nearest centroid by cosine names the language;
its distance rejects a text that is too far from every language. Distances grow as texts get shorter, so
that the radius is learnt for each power of two of the number of letters, from windows of the labelled texts.

The fit takes a bounded sample: up to PER_LANGUAGE labelled texts of each language, chosen by a hash of
doc_id. Everything else covers all rows and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlane.llm.common import chunks, with_key, with_row

DIMS = 1 << 13
PER_LANGUAGE, CENTROIDS, SLACK = 400, 4, 1.5
_BINS = 24

_LETTER = np.full(256, 32, np.uint8)
for _b in (*range(97, 123), *range(128, 256)):
    _LETTER[_b] = _b


def ngrams(data: np.ndarray) -> np.ndarray:
    """Cells of all 2- and 3-grams of a lower-case text's bytes."""
    b = np.empty(len(data) + 2, np.uint8)
    b[0] = b[-1] = 32
    b[1:-1] = _LETTER[data]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    b = b[keep].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + b[2:] * np.uint32(0xC2B2AE3D)
    two = two ^ two >> np.uint32(15)
    three = three ^ three >> np.uint32(13)
    return np.concatenate([two * np.uint32(0x27D4EB2F) >> np.uint32(19), three * np.uint32(0x165667B1) >> np.uint32(19)])


def counts(data: np.ndarray) -> np.ndarray:
    return np.bincount(ngrams(data), minlength=DIMS).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray  # centroids x DIMS
    idf: np.ndarray
    radius: np.ndarray  # largest distance accepted, by binary logarithm of the number of n-grams

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row language index, distance and whether it is accepted; a text without letters is not."""
        cos = self.vectors(tf) @ self.centroids.T
        best = cos.argmax(1)
        distance = 1 - cos[np.arange(len(tf)), best]
        n = tf.sum(1)
        return self.owner[best], distance, (n > 0) & (distance <= self.radius[_bin(n)])


def _bin(n: np.ndarray) -> np.ndarray:
    return np.minimum(_BINS - 1, np.log2(np.maximum(n, 1)).astype(np.int64))


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    c = [v[int((v @ v.mean(0)).argmax())]]
    while len(c) < min(k, len(v)):
        c.append(v[int((v @ np.array(c).T).max(1).argmin())])
    c = np.array(c)
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.array([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _windows(text: str, size: int) -> bytes:
    at = (len(text) - size) // 2
    return text[at : at + size].lower().encode()


def fit_texts(rows: list[tuple[str, str]], centroids: int = CENTROIDS, slack: float = SLACK) -> Model:
    """A model from (language, text) rows. Texts without letters are left out; so is the fifth of each
    language's texts least like its mean, which mislabelled and junk rows fall in, from its centroids."""
    rows = sorted(r for r in rows if r[0] and r[1])
    tf = [(lang, text, counts(np.frombuffer(text.lower().encode(), np.uint8))) for lang, text in rows]
    tf = [x for x in tf if x[2].sum() > 0]
    if not tf:  # nothing is known, so that everything is rejected
        return Model([], np.zeros(1, np.int64), np.zeros((1, DIMS), np.float32), np.zeros(DIMS, np.float32), np.full(_BINS, -1.0))
    m = np.array([x[2] for x in tf])
    idf = (np.log((1 + len(m)) / (1 + (m > 0).sum(0))) + 1).astype(np.float32)
    bare = Model([], np.zeros(0), np.zeros((0, DIMS)), idf, np.zeros(0))
    v = bare.vectors(m)
    langs = sorted({x[0] for x in tf})
    of = np.array([langs.index(x[0]) for x in tf])
    owner, cents = [], []
    for i in range(len(langs)):
        w = v[of == i]
        like = w @ w.mean(0)
        w = w[like >= np.quantile(like, 0.2)]
        c = _kmeans(w, centroids)
        owner += [i] * len(c)
        cents.append(c)
    model = Model(langs, np.array(owner), np.concatenate(cents).astype(np.float32), idf, np.full(_BINS, 2.0))
    # distances of whole texts and of windows, by size; then a radius that grows as texts get shorter
    seen: list[list[float]] = [[] for _ in range(_BINS)]
    core = [x for x, keep in zip(tf, _core(v, of), strict=True) if keep]
    for size in (0, 8, 16, 32, 64, 128, 256, 512, 1024):
        batch = [counts(np.frombuffer(_windows(x[1], size) if size else x[1].lower().encode(), np.uint8)) for x in core if len(x[1]) >= size]
        batch = np.array([b for b in batch if b.sum() > 0] or np.zeros((0, DIMS)))
        if len(batch):
            _, d, _ = model.nearest(batch)
            for b, x in zip(_bin(batch.sum(1)), d, strict=True):
                seen[b].append(float(x))
    radius = np.full(_BINS, np.nan)
    for b, x in enumerate(seen):
        if len(x) >= 20:
            radius[b] = np.quantile(x, 0.99)
    known = np.flatnonzero(~np.isnan(radius))
    radius = np.interp(np.arange(_BINS), known, radius[known]) if len(known) else np.full(_BINS, 1.0)
    radius = np.maximum.accumulate(radius[::-1])[::-1]  # never smaller for a shorter text
    return Model(langs, model.owner, model.centroids, idf, np.minimum(radius * slack, 0.97))


def _core(v: np.ndarray, of: np.ndarray) -> np.ndarray:
    keep = np.zeros(len(v), bool)
    for i in np.unique(of):
        like = v[of == i] @ v[of == i].mean(0)
        keep[np.flatnonzero(of == i)] = like >= np.quantile(like, 0.2)
    return keep


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, slack: float = SLACK) -> Model:
    """A model from the labelled rows (lang and text given) of docs, up to per_language of each language."""
    size = docs.where("lang is not null").groupBy("lang").count().collect()
    share = F.lit(0.0)
    for r in size:
        share = F.when(F.col("lang") == r["lang"], min(1.0, 1.5 * per_language / r["count"] + 20 / r["count"])).otherwise(share)
    u = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = docs.where("lang is not null and text is not null and length(text) > 0").withColumn("fit_u", u).where(F.col("fit_u") < share)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("fit_u", "text"))
    rows = some.select("lang", "text", nth.alias("nth")).where(F.col("nth") <= per_language).collect()
    return fit_texts([(r["lang"], r["text"]) for r in rows], centroids, slack)


def _classify(model: Model, batch_rows: int = 128):
    def run(batches):
        names = pa.array(model.languages or [None], pa.string())
        for batch in batches:
            best, dist, ok = (np.zeros(batch.num_rows, t) for t in (np.int64, np.float64, bool))
            for row, data, offs in chunks(batch.column("text")):
                for a in range(0, len(offs) - 1, batch_rows):
                    b = min(a + batch_rows, len(offs) - 1)
                    tf = np.array([counts(data[offs[i] : offs[i + 1]]) for i in range(a, b)])
                    best[row + a : row + b], dist[row + a : row + b], ok[row + a : row + b] = model.nearest(tf)
            some = dist < 1 - 1e-6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k_id"), batch.column("k_text"), names.take(pa.array(best, mask=~some)), pa.array(np.round(np.where(some, dist, 1.0), 6)), pa.array(ok)],
                names=["doc_id", "k_id", "k_text", "language", "distance", "accepted"],
            )

    return run


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    return with_key(docs).mapInArrow(_classify(model), "doc_id long, k_id long, k_text long, language string, distance double, accepted boolean")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, language, distance (cosine, 6 digits) and accepted.

    A null, empty or letterless text has no language, distance 1, and is rejected. Equal rows get equal
    results; of equally near centroids the first counts, languages being in alphabetical order. Other columns
    are ignored. An empty table gives none.
    """
    return _scored(docs, model).select("doc_id", "language", "distance", "accepted")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns as they were: one pass, no shuffle."""
    rows = with_row(docs).select("row")
    schema = rows.schema

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            text = pa.chunked_array([c.field("text") for c in table.column("row").chunks]).combine_chunks() if batch.num_rows else None
            if text is None:
                continue
            ok = np.zeros(batch.num_rows, bool)
            for row, data, offs in chunks(text):
                for a in range(0, len(offs) - 1, 128):
                    b = min(a + 128, len(offs) - 1)
                    tf = np.array([counts(data[offs[i] : offs[i + 1]]) for i in range(a, b)])
                    ok[row + a : row + b] = model.nearest(tf)[2]
            yield batch.filter(pa.array(ok))

    return rows.mapInArrow(run, schema).select("row.*")
