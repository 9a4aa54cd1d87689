"""Spark-first engine for auditing, cleaning and redacting collections of text, files and logs."""
