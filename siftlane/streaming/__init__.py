"""Redaction of a stream: the batch columns, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlane.operators.redact import Redactor, tally


def redact_stream(spark: SparkSession, path: str, schema: str, redactor: Redactor, text: str = "text", fmt: str = "parquet") -> DataFrame:
    """Rows of files as they arrive in a folder, redacted. Stateless: any output mode, any trigger."""
    return redactor.apply(spark.readStream.format(fmt).schema(schema).load(path), text)


def tally_stream(redacted: DataFrame) -> DataFrame:
    """Counts of what was matched so far; for output modes complete and update."""
    return tally(redacted)
