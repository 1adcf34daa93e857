"""What several operators share: columns, written tables and the arrays of an Arrow batch."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of texts and vectors are large: batches between the JVM and Python are kept to so many bytes.
BATCH_BYTES = 8 << 20


def importable(spark: SparkSession) -> None:
    """Let the Python workers of a local session find this package where only the driver's own
    path names it; on a cluster it is shipped with --py-files or installed. Also bounds the bytes
    of a batch, of which the JVM and Python hold several copies for each core."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(size)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later stages, which then
    need it. Where the C library cannot, nothing happens."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function of batches, giving memory back at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


#: Folders that kept() has made since finished() began, for each finished() that is under way.
_folders: list[list[str]] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table written in the shared folder and read back: lost executors cost no recomputation."""
    folder = work_folder(df.sparkSession, name)
    if _folders:
        _folders[-1].append(folder)
    return written(df, folder)


def finished(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The written table of what build returns. The tables that build kept on its way are removed:
    the result needs them no more, and later steps need the disk."""
    _folders.append([])
    try:
        out = build()
    finally:
        folders = _folders.pop()
    out = kept(out, name)
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def by_id(df: DataFrame, divisor: int) -> DataFrame:
    """Adds fold: crc32 of doc_id as text, modulo divisor. A null id has fold 0."""
    return df.withColumn("fold", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor, F.lit(0)).cast("int"))


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About most rows at most, spread evenly by a hash of key; for fitting only."""
    n = rows.count()
    if n <= most:
        return rows
    share = int(most / n * (1 << 30))
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < share)


#: Rows of a few numbers that may be broadcast, some 25 MB in a hash table.
FEW_ROWS = 1 << 18


def if_few(rows: DataFrame) -> DataFrame:
    """A written table, marked for broadcast where its counted rows are few; beyond that it is
    joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def sizes(items: list) -> np.ndarray:
    return np.fromiter(map(len, items), np.int64, len(items))
