"""Search of lines in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.functions.text import lines, strip


def search_lines(texts: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, lineno (from 1) and line (stripped) of the lines that contain query, case ignored. Texts without it are
    dropped before they are cut into lines."""
    q = F.lower(F.lit(query))
    rows = texts.where(F.lower(text).contains(q)).select(F.col(key), F.posexplode(lines(text)).alias("pos", "raw"))
    return rows.where(F.lower("raw").contains(q)).select(key, (F.col("pos") + 1).cast("long").alias("lineno"), strip("raw").alias("line"))


def search_totals(texts: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """matches, and files searched (not only those that match)."""
    n = F.size(F.filter(lines(text), lambda x: F.lower(x).contains(F.lower(F.lit(query)))))
    return texts.agg(F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias("matches"), F.countDistinct(key).alias("files"))
