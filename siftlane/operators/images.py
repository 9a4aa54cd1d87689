"""The relational half of picture and PDF redaction: observations to boxes. Pixels and OCR are plug-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.operators.recognizers import unavailable
from siftlane.operators.redact import Redactor

LEAST_CONFIDENCE = {"vision": 0.3, "tesseract": 50.0}
OCR: dict[str, Callable] = {}
PDF: dict[str, Callable] = {}


def backend(kind: str, registry: dict[str, Callable]) -> Callable:
    """The first registered backend; an error before any file is read if there is none."""
    return next(iter(registry.values())) if registry else unavailable(kind)


def confident(observations: DataFrame, engine: str) -> DataFrame:
    return observations.where(F.col("confidence") >= LEAST_CONFIDENCE[engine])


def boxes(observations: DataFrame, redactor: Redactor, tight: bool = False) -> DataFrame:
    """image, entity, matched and bbox to black out, one a raw match: the line's box, or with tight the part of it that
    the match's characters take up. Overlaps are not resolved here, so that counts are raw."""
    rows = observations.select("image", "bbox", "text", F.explode(redactor.analyze("text")).alias("x"))
    n, w = F.greatest(F.lit(1), F.length("text")), F.col("bbox.x1") - F.col("bbox.x0")
    part = F.struct(
        (F.col("bbox.x0") + F.floor(w * F.col("x.s") / n)).cast("int").alias("x0"), F.col("bbox.y0").alias("y0"),
        (F.col("bbox.x0") + F.ceil(w * F.col("x.e") / n)).cast("int").alias("x1"), F.col("bbox.y1").alias("y1"),
    )
    line = F.struct(*(F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))
    return rows.select("image", F.col("x.entity").alias("entity"), F.col("x.text").alias("matched"), (part if tight else line).alias("bbox"))


def blackout_counts(box_rows: DataFrame) -> DataFrame:
    return box_rows.where(F.col("entity").startswith("KW_")).groupBy("entity").agg(F.count("*").alias("count"))


def page_kind(pages: DataFrame) -> DataFrame:
    """A PDF page without text is scanned and goes to OCR; others are searched."""
    return pages.withColumn("kind", F.when(F.col("text").rlike(r"(?U)\S"), "digital").otherwise("scanned"))


def placed(hits: DataFrame) -> DataFrame:
    """Only phrases found on the page count."""
    return hits.where(F.size("quads") > 0)


def crop_bands(images: DataFrame, rows: int) -> DataFrame:
    """y0 and y1 of equal bands of each image."""
    return images.select("image", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("band")).select("image", "band", (F.col("band") / rows).alias("y0"), ((F.col("band") + 1) / rows).alias("y1"))
