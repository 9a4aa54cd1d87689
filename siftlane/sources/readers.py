"""Readers that turn files into (path, text) rows by the decoding rules of each format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.functions.text import decode
from siftlane.operators.documents import csv_cells, docx_markdown
from siftlane.sources.tree import content


def read(files: DataFrame, *extensions: str) -> DataFrame:
    """path and content of the files with these extensions; content is read after the filter."""
    name = F.lower("path")
    ok = F.lit(False)
    for e in extensions:
        ok |= name.endswith(e)
    return files.where(~F.col("is_dir") & ok).select("path", content("abs_path").alias("content"))


def text_files(files: DataFrame) -> DataFrame:
    return read(files, ".md", ".txt").select("path", decode("content").alias("text"))


def html_files(files: DataFrame) -> DataFrame:
    return read(files, ".html", ".htm").select("path", decode("content").alias("text"))


def json_files(files: DataFrame) -> DataFrame:
    return read(files, ".json").select("path", decode("content", bom=True).alias("text"))


def csv_files(files: DataFrame) -> DataFrame:
    """Bytes that aren't UTF-8 end the query, as they must not become other characters in a table."""
    return read(files, ".csv").select("path", csv_cells(decode("content", strict=True, bom=True)).alias("cells"))


def docx_files(files: DataFrame) -> DataFrame:
    return read(files, ".docx").select("path", docx_markdown("content").alias("text"))


def ocr_rows(lines: DataFrame) -> DataFrame:
    """image, ord, x, y and text from (image, ord, line) with tab-separated fields; other lines and blank texts go."""
    f = F.split("line", "\t")
    rows = lines.where((F.size(f) == 3) & F.get(f, F.lit(2)).rlike(r"(?U)\S"))
    return rows.select("image", "ord", F.get(f, F.lit(0)).try_cast("double").alias("x"), F.get(f, F.lit(1)).try_cast("double").alias("y"), F.get(f, F.lit(2)).alias("text")).where("x is not null and y is not null")
