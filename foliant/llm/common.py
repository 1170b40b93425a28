"""What the operators of this subpackage share: reading, bounded Arrow batches, tables in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch that goes to a Python worker; bounds the workers' memory.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

#: Bytes of a row group of a table between steps; bounds the writers' memory.
ROW_GROUP_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='foliant-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs without it one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    return found or _own_dir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have ended before
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove stored() tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.scratch)


def release() -> None:
    """Give a worker's free memory back to the system: workers live on, idle or for other stages, beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input cannot clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def open_store(uri: str):
    """The pyarrow file system and path of a folder or file that Spark names by a URI. Schemes that only Spark's readers
    know stand for what they reach: s3a and s3n for s3, dbfs for its mount."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif colon and scheme == "dbfs":
        uri = f"/dbfs/{rest.lstrip('/')}"
    return fs.FileSystem.from_uri(uri)
