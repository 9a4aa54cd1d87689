"""What the operators of this subpackage share: scratch tables, row keys, byte-level tokens."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside an Arrow batch, in bytes. A single longer text is one chunk.
CHUNK_BYTES = 1 << 19
ARROW_ROWS = 1000
U64 = np.uint64


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a folder of its own only in local mode where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="siftlane-")
    spark.conf.set("spark.checkpoint.dir", path)
    atexit.register(_remove_local, path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_ROWS rows where the session has Spark's default of 10,000, which are 30 MB and more of text, once
    in the JVM and once in Python for each task."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it again: cuts lineage, survives lost executors, has statistics.
    by: a column whose values are folders. The table goes when the process ends, or by release()."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/siftlane-{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftlane_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of materialize() that no later result reads."""
    for t in tables:
        _remove(t.sparkSession, t._siftlane_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has gone
        pass


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def expand(blob: bytes, kind) -> np.ndarray:
    n, kind = int.from_bytes(blob[:8], "little"), np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(_ZSTD.decompress(blob[8:], n, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def squeeze_rising(x: np.ndarray) -> bytes:
    """squeeze() of rising 64-bit numbers, by their differences."""
    return squeeze(np.diff(x, prepend=U64(0)))


def expand_rising(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, U64), dtype=U64)


def text_key(text: str = "text") -> Column:
    """Content half of a row's identity; with doc_id it names a row, and equal pairs are repeated rows."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\x00null")))


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row key (k_id: doc_id, or the largest long for null; k_text); the names can't clash with columns of docs."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("k_id"),
        text_key().alias("k_text"),
    )


def with_row(docs: DataFrame) -> DataFrame:
    """The row key beside the whole row as a struct `row`, so that no column of docs can clash with it."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("k_id"),
        text_key().alias("k_text"),
        F.struct("*").alias("row"),
    )


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, over uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def chunks(texts: pa.Array, lower: bool = True, limit: int = CHUNK_BYTES):
    """Yields (first row, bytes, offsets) over rows of a string array; null counts as empty. Only a chunk at a time is copied."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a, done = 0, 0
    while a < n:
        b = min(n, max(int(np.searchsorted(ends, done + limit, side="right")), a + 1))
        part = pc.fill_null(texts.slice(a, b - a).cast(pa.large_string()), "")
        if lower:
            part = pc.utf8_lower(part)
        offs = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + b - a + 1]
        raw = part.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        yield a, data[offs[0] : offs[-1]], offs - offs[0]
        a, done = b, int(ends[b - 1])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POW = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, dtype=U64))


def tokens(data: np.ndarray, offs: np.ndarray, words: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every token. Tokens are split by ASCII white space, or with words=True by
    whatever is not a letter, digit or non-ASCII byte; they never run over a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    inside = _WORD[data] if words else ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offs[:-1][offs[:-1] < len(data)]
    start[edge] = inside[edge]
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, np.zeros(0, U64)
    first = np.zeros(len(data), np.int32)
    first[starts] = np.diff(starts, prepend=0)
    pos = np.arange(len(data), dtype=np.int32) - np.cumsum(first, dtype=np.int32)
    value = data.astype(U64)
    value += U64(1)
    if int(pos.max()) < len(_POW):
        value *= _POW[pos]
    else:  # every further 64 KiB of a token have a factor of their own
        value *= _POW[pos & (len(_POW) - 1)] * (mix((pos >> 16).astype(U64)) | U64(1))
    value[~inside] = 0
    return starts, mix(np.add.reduceat(value, starts))


_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_LONG = 256


def space_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As tokens() by white space, with another hash, of eight bytes at a time: a step for each token instead of each byte.
    Tokens of over 256 bytes are hashed by tokens()."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    space = _SPACE[data]
    start, last = ~space, ~space
    start[1:] &= space[:-1]
    last[:-1] &= space[1:]
    edge = offs[:-1][offs[:-1] < len(data)]
    start[edge] = ~space[edge]
    edge = edge[edge > 0]
    last[edge - 1] = ~space[edge - 1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, np.zeros(0, U64)
    size = np.flatnonzero(last) + 1 - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    word = np.ndarray(len(data), "<u8", padded, strides=(1,))
    h = mix(word[starts] & _BYTES[np.minimum(size, 8)] ^ size.astype(U64) << U64(56))
    at, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(at):
        h[at] = mix(h[at] + U64(0x9E3779B97F4A7C15) ^ word[starts[at] + done] & _BYTES[np.minimum(size[at] - done, 8)])
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > _LONG):
        h[i] = tokens(data[starts[i] : starts[i] + size[i]], np.array([0, size[i]]))[1][0]
    return starts, h


def group_by_part(rec: np.ndarray, hashed: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (part, rows) for a shuffle of packed records: one blob of rec for each of `parts` hash partitions."""
    part = (mix(hashed) % U64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    rec, part = rec[order], part[order]
    ids, first = np.unique(part, return_index=True)
    blobs = [np.ascontiguousarray(rec[i:j].view(np.uint8).reshape(j - i, -1).T).tobytes() for i, j in zip(first, [*first[1:], len(rec)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "rows"])


def unpack(table: pa.Table, kind: np.dtype) -> np.ndarray:
    """The records of all blobs of a partition. Blobs hold byte planes, in which what is alike lies together."""
    raw = (np.frombuffer(x, np.uint8).reshape(kind.itemsize, -1).T for x in table.column("rows").to_pylist())
    return np.concatenate([np.ascontiguousarray(x).reshape(-1).view(kind) for x in raw])


def runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Positions where a run of equal rows begins."""
    n = len(sorted_columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def bitmap(hashes: DataFrame, column: str, keys: int | None = None) -> np.ndarray:
    """Bits set for the hashes: a prefilter before an exact join. Eight bits a key, from 2**20 to 2**28 (32 MB) in all;
    beyond 2**28 it lets more and more rows through to the join, which alone decides. keys: their number, if known."""
    if keys is None:
        keys = hashes.count()
    bits = min(28, max(20, int(keys).bit_length() + 3))
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = hashes.groupBy(F.shiftrightunsigned(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return out.view(U64)


def hits(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(U64, copy=False) >> U64(64 - (len(filter_).bit_length() + 5))
    return (filter_[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)


def may_hold(filter_: np.ndarray):
    """A UDF over a long column: may the bitmap hold it? The exact join comes after it."""

    @F.pandas_udf("boolean")
    def run(hashes: pd.Series) -> pd.Series:
        return pd.Series(hits(filter_, hashes.to_numpy(np.int64).view(U64)))

    return run
