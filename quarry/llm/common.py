"""Shared helpers: input tables, shared working folders, batch slicing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only; a null text is empty. Other columns are dropped, so their names can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: Stands for a null doc_id where rows are told apart: one id, below all others.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id (NO_ID for null), tid (a hash of the text), text (empty for null) and the columns to keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"), *keep)


def marked(docs: DataFrame) -> DataFrame:
    """_row (all columns, so that no name of theirs clashes), _doc (doc_id, NO_ID for null) and _tid (a hash of the text)."""
    return docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tid"))


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Only a local session may name none: then a temporary folder is used. On a
    cluster each executor would write to its own disk, so the job fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd", dictionary: bool = True) -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts lineage and survives lost executors.

    Its bytes as plain numbers (see sized) are counted while it is written.
    Columns of hashes gain nothing from a dictionary.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    seen = Observation()
    df.observe(seen, F.sum(_values(df)).alias("values")).write.option("compression", codec).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _sizes[out] = 8 * (seen.get.get("values") or 0)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        folder = _paths.pop(df, None)
        if folder:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_sizes: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def _values(df: DataFrame) -> Column:
    """Values of 8 bytes that a row takes, two of them for the row itself; strings and bytes by their length."""
    out = F.lit(2 + len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out = out + F.coalesce(F.size(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(f.name) / 8, F.lit(0.0)).cast("long")
    return out.cast("long")


def sized(df: DataFrame) -> int:
    """Bytes of a table of numbers, strings and arrays of numbers: counted when it was stored, else now."""
    if df not in _sizes:
        _sizes[df] = 8 * (df.agg(F.sum(_values(df))).first()[0] or 0)
    return _sizes[df]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives back at its end what memory its worker no longer uses: other stages of the executor need it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of some C libraries only
    if trim:
        trim(0)


#: Bytes of rows in an Arrow batch. The session's default bounds rows alone (10,000), and each task holds batches in the JVM and in Python.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session's Arrow batches hold at most so many bytes, a row at least; a lower bound that it has stays."""
    if not 0 < int(str(spark.conf.get(_BATCH)).rstrip("bB")) <= most:
        spark.conf.set(_BATCH, most)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of batch in runs whose values of a string column take at most max_bytes; a longer value stands alone.

    Bounds the memory of numpy code by the slice, whatever the batch size.
    """
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield batch.slice(at, end - at)
        at, done = end, int(ends[end - 1])


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls and the n+1 offsets of its values, without copying."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]
