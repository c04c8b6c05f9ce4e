"""What the operators of this subpackage share: the folder all executors see, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

#: Rows of a staged table that may be broadcast; above it the same join runs as a shuffle join.
BROADCAST_ROWS = 2_000_000
#: Bytes of such a table, as rows times the width its caller states.
BROADCAST_BYTES = 64 << 20

_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a fresh temporary one only where that is unset on a single machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-shared-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the application's folder, which is deleted when the driver's Python ends."""
    top = shared_dir(spark)
    if top not in _cleaned:
        _cleaned.add(top)
        atexit.register(_clean, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def _clean(spark: SparkSession, top: str) -> None:
    with contextlib.suppress(Exception):  # the driver's JVM may be gone
        delete(spark, top)


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, and has known statistics."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tm_path = path
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, *staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let Spark drop the shuffle files of what led to them.

    Spark's cleaner removes a shuffle's files once the driver has no reference to it, which it learns at its next
    collection; without this, a job of many steps holds all of its shuffles to the end.
    """
    delete(spark, *[df.tm_path for df in staged])
    gc.collect()
    spark._jvm.System.gc()


def fits(df: DataFrame, row_bytes: int = 32) -> bool:
    """Whether a staged table may be broadcast: by its rows, of row_bytes at least, and the bytes of strings, binaries and arrays in them."""
    each = F.lit(row_bytes)
    for f in df.schema:
        if isinstance(f.dataType, (StringType, BinaryType)):
            each = each + F.coalesce(F.octet_length(df[f.name]), F.lit(0))
        elif isinstance(f.dataType, ArrayType):
            each = each + F.coalesce(32 * F.size(df[f.name]), F.lit(0))
    rows, size = df.agg(F.count("*"), F.sum(each.cast("long"))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def small(df: DataFrame, row_bytes: int = 32) -> DataFrame:
    """A staged table, marked for broadcast if it `fits`; otherwise as it is (shuffle join)."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def cleanup(spark: SparkSession) -> None:
    """Delete what this application has staged, once no result that reads it is needed any more."""
    delete(spark, shared_dir(spark))


def with_fields(schema: StructType, ddl: str) -> StructType:
    """schema and further fields, whatever its columns are called."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def text_key(text) -> F.Column:
    """64 bits of the text (null as empty); beside doc_id it tells rows that repeat a doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """read, giving freed memory back to the system after each batch and at its end: a worker, which later tasks use again, else keeps its peak."""

    def spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            _trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from read(spaced(batches))
        finally:
            _trim()

    return run
