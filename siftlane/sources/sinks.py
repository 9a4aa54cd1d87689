"""Sinks: a mirrored tree, a copy of planned files, JSON reports."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _inside(root: str, rel: str) -> str:
    path = os.path.abspath(os.path.join(root, rel))
    if os.path.commonpath([path, os.path.abspath(root)]) != os.path.abspath(root):
        raise ValueError(f"{rel} leaves the output folder")
    return path


def _put(path: str, write) -> None:
    """Written beside its place and moved there, so that a task that runs twice never leaves half a file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    write(part)
    os.replace(part, path)


def write_tree(rows: DataFrame, root: str, path: str = "path", text: str = "text") -> DataFrame:
    """Write (path, text) rows below root, a shared folder, and give path and bytes written. Nothing is collected."""
    root = os.path.abspath(root)  # as the driver sees it: executors have other working directories

    def run(batches):
        for pdf in batches:
            n = []
            for rel, body in zip(pdf["path"], pdf["text"], strict=True):
                data = (body or "").encode()
                _put(_inside(root, rel), lambda p, d=data: _dump(p, d))
                n.append(len(data))
            yield pdf[["path"]].assign(bytes=n)

    return rows.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, "path string, bytes long")


def _dump(path: str, data: bytes) -> None:
    with open(path, "wb") as f:
        f.write(data)


def copy_files(plan: DataFrame, source: str, target: str) -> DataFrame:
    """Carry out the copy and recopy rows of a copy plan; path, action and error (null if none). A column `final` is the
    name that the copy gets."""
    source, target = os.path.abspath(source), os.path.abspath(target)

    def run(batches):
        for pdf in batches:
            errors = []
            for rel, final in zip(pdf["path"], pdf["final"], strict=True):
                try:
                    _put(_inside(target, final), lambda p, s=os.path.join(source, rel): shutil.copy2(s, p))
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pdf[["path", "action"]].assign(error=errors)

    final = F.col("final" if "final" in plan.columns else "path").alias("final")
    return plan.where(F.col("action").isin("copy", "recopy")).select("path", "action", final).mapInPandas(run, "path string, action string, error string")


def write_report(groups: DataFrame, path: str) -> None:
    """Duplicate groups as JSON lines, by hash."""
    groups.orderBy("hash").write.mode("overwrite").json(path)
