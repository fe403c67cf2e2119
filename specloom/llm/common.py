"""What the operators of this subpackage share: input tables, working tables in the shared folder, word rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="specloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a working table; removed when the application ends."""
    path = f"{shared_dir(spark)}/specloom/{name}-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes working tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.settled_at)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches that tasks send to Python, for the session from then on: Spark reads the limit when a plan runs. Its default is
    64 MB, so a whole partition of texts can be one batch, held by the executor's buffers and by Python at once. A limit that the session has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_BYTES)


def give_back() -> None:
    """Returns freed memory to the system: Python workers are reused, and what one task leaves allocated its neighbours can't have."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """A function for mapInArrow that gives memory back at the end of its task."""

    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return over_batches


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words of a text as an array (null text: empty array)."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda w: w != "")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Slices of an Arrow batch whose texts take about ``limit`` bytes each; a single longer text is a slice of its own.
    Later slices are copied: some string kernels misread arrays that start inside a buffer."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + limit, "right")))
        yield batch.slice(start, end - start) if start == 0 else batch.take(pa.array(np.arange(start, end)))
        start = end


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for each text the position where its words start (one more entry than texts)."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = parts.flatten()
    offsets = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets -= offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return flat, offsets
    kept = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), kept[offsets]
