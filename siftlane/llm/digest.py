"""Operator 4, document fingerprints: canonical exact digest.

A text's canonical form is NFKC, case folded, NFKC again, every run of white space one space and none at the
ends. Its fingerprint is the 128-bit xxh3 of that form in UTF-8. Documents with equal fingerprints are compared
byte by byte: only forms that are equal make a group. Only documents whose fingerprint occurs twice have their
form shuffled; a fixed bitmap keeps the others from it and an exact join does the rest.
"""

from __future__ import annotations

from unicodedata import normalize

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlane.llm.common import U64, bitmap, hits, materialize, with_key


def canonical(text: str) -> bytes:
    text = text.lower() if text.isascii() else normalize("NFKC", normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


_KEYS = ("doc_id", "k_id", "k_text")


def _digest(dups: np.ndarray | None):
    """With dups only rows whose digest it may hold, with their form."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                forms = [None if t is None else canonical(t) for t in column.slice(a, 256).to_pylist()]
                raw = np.array([0 if f is None else xxhash.xxh3_128_intdigest(f) for f in forms], dtype=object)
                hi, lo = (np.array([int(x) for x in v], U64) for v in (raw >> 64, raw & (2**64 - 1)))
                none = np.array([f is None for f in forms], bool)
                columns = [*(part.column(k) for k in _KEYS), pa.array(hi.view(np.int64), mask=none), pa.array(lo.view(np.int64), mask=none)]
                names = [*_KEYS, "hi", "lo"]
                if dups is None:
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    continue
                at = np.flatnonzero(hits(dups, hi) & ~none)
                if len(at):
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in columns), pa.array([forms[i] for i in at], pa.binary())], names=[*names, "form"])

    return run


_SCHEMA = "doc_id long, k_id long, k_text long, hi long, lo long"


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, fingerprint (32 hex digits), group_id (smallest doc_id of the group), group_size
    and keep (true for one document of each group: the smallest doc_id, null last; any of rows that repeat wholly).

    A null text has no fingerprint and is a group of its own; empty and blank texts are equal to each other. A null
    doc_id stays null, its text is grouped as any other. Very long texts are whole. Other columns are ignored. An empty
    table gives none.

    Groups are aggregates that are joined back, so that neither nulls nor a group of millions meet in one task.
    """
    keyed = with_key(docs)
    rows = materialize(keyed.mapInArrow(_digest(None), _SCHEMA).withColumn("rid", F.monotonically_increasing_id()), "digests")
    dups = materialize(rows.where("hi is not null").groupBy("hi", "lo").count().where("count > 1").select("hi", "lo"), "dups")
    forms = keyed.mapInArrow(_digest(bitmap(dups, "hi")), _SCHEMA + ", form binary").join(dups, ["hi", "lo"], "left_semi")
    size, least = F.count("*").alias("group_size"), F.min("doc_id").alias("group_id")
    equal = materialize(forms.groupBy("hi", "lo", "form").agg(size, least).withColumn("forms", F.count("*").over(Window.partitionBy("hi", "lo"))), "forms")
    hexed = F.lower(F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0"))).alias("fingerprint")
    # a digest with one form, as all have, makes a group by itself
    one = equal.where("forms = 1").select("hi", "lo", "group_size", "group_id")
    first = rows.join(one, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.min(F.struct("k_id", "k_text", "rid"))["rid"].alias("lead"))
    many = rows.join(one.join(first, ["hi", "lo"]), ["hi", "lo"]).select("doc_id", hexed, "group_id", "group_size", (F.col("rid") == F.col("lead")).alias("keep"))
    # different texts with one digest are told apart by their bytes
    nth = F.row_number().over(Window.partitionBy("hi", "lo", "form").orderBy("k_id", "k_text"))
    clash = forms.join(equal.where("forms > 1").drop("forms"), ["hi", "lo", "form"]).select("doc_id", hexed, "group_id", "group_size", (nth == 1).alias("keep"))
    alone = rows.join(dups, ["hi", "lo"], "left_anti").select("doc_id", hexed, F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep"))
    return alone.unionByName(many).unionByName(clash)
