"""What the corpus operators share: the cluster's shared folder, written intermediates, text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

#: Rows of one Arrow batch: texts may be long, so batches hold few of them.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster that is an error, as executors can't read the driver's.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="nickline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Deletes a write's shuffle files when the write has ended, and not when the driver's garbage happens to be collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def released() -> None:
    """Gives memory that Python has freed back to the system, where the C library can (glibc); else the driver's process keeps it to the end."""
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again, so that its lineage is cut.

    What nothing reads any more is deleted by drop(); the rest, which results still read, goes when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nickline/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Deletes the files of frames that were saved and that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Python workers know this package and get at most so many rows at a time."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """All columns of df as the struct `row`, so that names an operator adds can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def per_text(fn, kind: str):
    """A function of iterators of Arrow arrays as a column function, run once where it stands: it isn't pushed or repeated."""
    return F.arrow_udf(fn, kind).asNondeterministic()


def utf8(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a column of strings; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64), memoryview(b"")
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, memoryview(data if data is not None else b"")


def texts(column: pa.Array):
    """The bytes of each text."""
    at, data = utf8(column)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield bytes(data[a:b])


#: Bytes of UTF-8 text: A-Z in lower case; 0-9, a-z and bytes of other alphabets stay; the rest becomes a space.
ALNUM = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case."""
    return text.translate(ALNUM).split()
