"""A file tree as a DataFrame, hidden names included (the built-in binaryFile source drops them)."""

from __future__ import annotations

import hashlib
import os
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf

SCHEMA = "path string, abs_path string, is_dir boolean, size long, ts timestamp, time_type string"
CHUNK = 1 << 16


class _Part(InputPartition):
    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(folders)
        self.folders = folders


class _Reader(DataSourceReader):
    """Lists the top of the tree on the driver and everything below it on the executors."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.slices = int(options.get("partitions", 32))
        self.skip = frozenset(x for x in options.get("skipDirs", "").split(",") if x)
        self.ext = tuple(x for x in options.get("extensions", "").lower().split(",") if x)

    def partitions(self):
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        below = [(e.path, True) for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and e.name not in self.skip]
        slices = [below[i :: self.slices] for i in range(min(self.slices, len(below)))]
        return [_Part([(self.root, False)]), *(_Part(s) for s in slices)]

    def _row(self, path: str, is_dir: bool):
        try:
            st = os.stat(path, follow_symlinks=False)
        except OSError:
            return None
        birth = getattr(st, "st_birthtime", None)
        ts = datetime.fromtimestamp(birth if birth is not None else st.st_mtime, timezone.utc)
        return os.path.relpath(path, self.root), path, is_dir, st.st_size, ts, "modified" if birth is None else "created"

    def read(self, partition):
        for folder, deep in partition.folders:
            if deep and (row := self._row(folder, True)):
                yield row
            for at, dirs, files in os.walk(folder):
                dirs[:] = sorted(d for d in dirs if d not in self.skip) if deep else []
                for name, is_dir in [*((d, True) for d in dirs), *((f, False) for f in sorted(files))]:
                    if is_dir or not self.ext or name.lower().endswith(self.ext):
                        if row := self._row(os.path.join(at, name), is_dir):
                            yield row


class TreeSource(DataSource):
    """format('siftlane-tree'), options path, partitions, skipDirs and extensions (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "siftlane-tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """Everything below root. The folder must be reachable from every executor."""
    spark.dataSource.register(TreeSource)
    return spark.read.format(TreeSource.name()).options(path=root, **options).load()


@pandas_udf(T.BinaryType())
def content(paths: pd.Series) -> pd.Series:
    """A file's bytes; null where it can't be read. Filter the listing first: this is the expensive step."""

    def one(p):
        try:
            with open(p, "rb") as f:
                return f.read()
        except OSError:
            return None

    return paths.map(one)


def digest(paths: Column | str, algorithm: str = "md5") -> Column:
    """Hash of a file in chunks, so that no file has to fit in memory; null where it can't be read."""

    @pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(p):
            h = hashlib.new(algorithm)
            try:
                with open(p, "rb") as f:
                    while block := f.read(CHUNK):
                        h.update(block)
            except OSError:
                return None
            return h.hexdigest()

        return values.map(one)

    return run(paths)


def duplicates(files: DataFrame, algorithm: str = "md5") -> DataFrame:
    """hash, count, size_bytes and paths of equal files. Only sizes that occur twice are read."""
    real = files.where(~F.col("is_dir"))
    twice = real.groupBy("size").agg(F.count("*").alias("k")).where("k > 1").select("size")
    rows = real.join(twice, "size", "left_semi").select("path", "size", "ts", digest("abs_path", algorithm).alias("hash")).where("hash is not null")
    order = F.array_sort(F.collect_list(F.struct("ts", "path")))
    return rows.groupBy("hash", "size").agg(F.count("*").alias("count"), order.alias("x")).where("count > 1").select("hash", "count", F.col("size").alias("size_bytes"), F.transform("x", lambda t: t["path"]).alias("paths"))
