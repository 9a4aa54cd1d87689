"""Operator 2, mixing sources to target weights by Efraimidis-Spirakis sampling.

A source with target share s of the token budget B takes s * B tokens. floor(s * B / its tokens) whole
epochs come first: every document that often. The rest is a weighted sample without replacement: key
-ln(u) / w for quality weight w and u uniform from the document's hash, in ascending order, as long as
the tokens so far fit.

No source is sorted as a whole, however large. Keys fall into 2**16 cells of about equal mass; tokens per
(source, cell) give the one cell in which the budget ends, and only that cell's documents are sorted. What
is selected is then a comparison with a threshold per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlane.llm.common import bitmap, materialize, may_hold

CELLS = 1 << 16
QUALITY = {1: 2.0, 0: 0.5}
ALPHA = 0.5


def token_count(text: str = "text") -> Column:
    """Tokens split by ASCII white space, as a long; null counts as none."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^ \\t\\n\\r\\f\\x0b]+", "x")
    return F.length(F.regexp_replace(body, "[ \\t\\n\\r\\f\\x0b]+", "")).cast("long")


def _uniform(seed: int) -> Column:
    """In (0, 1), from the first 52 bits of md5(seed:doc_id)."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(h, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _best_label(quality: DataFrame) -> DataFrame:
    """q_id and q: a document labelled twice counts by its best label."""
    return quality.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("q_id")).agg(F.max("quality").alias("q"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), token_count().alias("tokens"), *more)


def _key(seed: int, q: Column | None = None) -> Column:
    w = F.lit(1.0) if q is None else F.coalesce(*(F.when(q == k, F.lit(v)) for k, v in QUALITY.items()), F.lit(1.0))
    return (-F.log(_uniform(seed)) / w).alias("key")


def _keyed(docs: DataFrame, quality: DataFrame | None, seed: int) -> DataFrame:
    rows = _sized(docs)
    if quality is None:
        return rows.select("*", _key(seed))
    return rows.join(_best_label(quality), F.col("doc_id") == F.col("q_id"), "left").select("doc_id", "source", "tokens", _key(seed, F.col("q")))


def _cell() -> Column:
    return F.least(F.lit(CELLS - 1), F.floor((1 - F.exp(-F.col("key"))) * CELLS)).cast("int")


def plan(rows: DataFrame, weights: dict[str, float] | None, budget: int | None, alpha: float) -> DataFrame:
    """For each source: epochs, and the last (key, doc_id) of the fractional part, null where there is none."""
    cells = materialize(rows.groupBy("source", _cell().alias("cell")).agg(F.sum("tokens").alias("t")), "cells")
    source = cells.groupBy("source").agg(F.sum("t").alias("t")).where("t > 0")
    if weights is None:
        share = F.col("t").cast("double") ** F.lit(alpha)
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source") == name, F.lit(float(w))).otherwise(share)
    sums = source.select("source", "t", share.alias("share")).where("share > 0")
    total = sums.agg(F.sum("share").alias("all_share")).crossJoin(source.agg(F.sum("t").cast("double").alias("all_t")))
    want = F.col("share") / F.col("all_share") * (F.lit(float(budget)) if budget is not None else F.col("all_t"))
    target = sums.crossJoin(F.broadcast(total)).select("source", "t", want.alias("want"))
    target = target.select("source", F.floor(F.col("want") / F.col("t")).cast("long").alias("epochs"), (F.col("want") - F.floor(F.col("want") / F.col("t")) * F.col("t")).alias("rest"))
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("cell"))
    edge = (
        cells.select("source", "cell", (upto - F.col("t")).alias("before"), upto.alias("upto"))
        .alias("c")
        .join(target.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
        .select("g.source", "epochs", "rest", "cell", "before", "upto")
        .where("upto > rest")
        .groupBy("source", "epochs", "rest")
        .agg(F.min_by(F.struct("cell", "before"), "cell").alias("edge"))
        .select("source", "epochs", "rest", "edge.cell", "edge.before")
    )
    edge = materialize(edge, "edge").alias("e")
    at = rows.withColumn("cell", _cell()).alias("r").join(edge, F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.cell") == F.col("e.cell")))
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first()))
    fits = (
        at.select("e.source", "tokens", "key", "doc_id", "before", "rest")
        .select("source", "key", "doc_id", (F.col("before") + run).alias("upto"), "rest")
        .where("upto <= rest")
        .groupBy("source")
        .agg(F.max(F.struct("key", "doc_id")).alias("last"))
        .alias("f")
    )
    return edge.join(fits, F.col("e.source").eqNullSafe(F.col("f.source")), "left").select("e.source", "e.epochs", "e.cell", "f.last")


def _copies(rows: DataFrame, plan_: DataFrame, *more: str) -> DataFrame:
    p = plan_.alias("p")
    inside = (F.col("r.cell") < F.col("p.cell")) | (
        (F.col("r.cell") == F.col("p.cell")) & F.coalesce(F.struct("r.key", "r.doc_id") <= F.col("p.last"), F.lit(False))
    )
    copies = F.col("p.epochs") + inside.cast("long")
    joined = rows.withColumn("cell", _cell()).alias("r").join(p, F.col("r.source").eqNullSafe(F.col("p.source")))
    return joined.select("r.doc_id", "r.source", "r.tokens", *(f"r.{c}" for c in more), copies.alias("copies")).where("copies > 0")


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: dict[str, float] | None = None, budget: int | None = None, alpha: float = ALPHA, seed: int = 7) -> DataFrame:
    """doc_id, source, tokens and copies of every document taken at least once.

    weights: target share of each source, scaled to 1; without it a source's share goes with its tokens to the
    power alpha. budget: tokens in all; without it as many as docs has. quality: doc_id and quality (1 or 0;
    other or none count between). The fractional part never goes over its source's budget. Documents with equal
    keys (repeated doc_id) are taken together or not at all. Null sources are one source; one that weights
    doesn't name, or that has no tokens, is left out. Null and empty texts have 0 tokens and come with their
    source's order. Null doc_ids share one key. Other columns are ignored. An empty table gives none.
    """
    rows = materialize(_keyed(docs, quality, seed), "keys")
    return _copies(rows, plan(rows, weights, budget, alpha))


def mixed(docs: DataFrame, quality: DataFrame | None = None, weights: dict[str, float] | None = None, budget: int | None = None, alpha: float = ALPHA, seed: int = 7) -> DataFrame:
    """The documents that mix() takes, each as often as it says, with all their columns as they were."""
    chosen = materialize(plan(materialize(_keyed(docs, quality, seed), "keys"), weights, budget, alpha), "plan")
    # the plan is a row a source; of the texts only those of documents with a label are shuffled, to meet it
    rows = _sized(docs, F.struct("*").alias("row"))
    if quality is None:
        rows = rows.select("*", _key(seed))
    else:
        q = materialize(_best_label(quality), "labels")
        labelled = may_hold(bitmap(q.select(F.xxhash64("q_id").alias("h")).distinct(), "h"))
        rows = rows.withColumn("labelled", labelled(F.xxhash64("doc_id")))
        met = rows.where("labelled").join(q, F.col("doc_id") == F.col("q_id"), "left")
        rows = rows.where("not labelled").select("doc_id", "source", "tokens", "row", _key(seed)).unionByName(met.select("doc_id", "source", "tokens", "row", _key(seed, F.col("q"))))
    return _copies(rows, chosen, "row").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


ORACLE = f"""
WITH n AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0b]+', 'x', 'g'), '[ \\t\\n\\r\\f\\x0b]+', '', 'g'))::BIGINT AS tokens FROM documents
), q AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id
), k AS (
  SELECT n.*, -ln((('0x' || substr(md5('7:' || n.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)}) / CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
  FROM n LEFT JOIN q USING (doc_id)
), s AS (SELECT source, sum(tokens)::BIGINT AS t FROM k GROUP BY source HAVING sum(tokens) > 0
), w AS (SELECT source, t, sqrt(t::DOUBLE) / (SELECT sum(sqrt(t::DOUBLE)) FROM s) * (SELECT sum(t) FROM s)::DOUBLE AS want FROM s
), e AS (SELECT source, floor(want / t)::BIGINT AS epochs, want - floor(want / t) * t AS rest FROM w
), r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id) AS upto FROM k)
SELECT r.doc_id, r.source, r.tokens, e.epochs + (upto <= rest)::BIGINT AS copies
FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source WHERE e.epochs + (upto <= rest)::BIGINT > 0
"""
