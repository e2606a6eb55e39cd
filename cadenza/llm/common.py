"""What the text operators share: reading tables, the shared folder, hold-out rules."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset a session on one machine gets a local
    one of its own; on several machines there is none that all of them see, so it has to be named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="cadenza-shared-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables written since each open `temporary` began, the innermost last.
_OPEN: list[list[str]] = []


def materialize(df: DataFrame, tag: str, outlive: bool = False) -> DataFrame:
    """df written as a table of the shared folder and read again: lineage ends there, and columns can be pruned. Within
    `temporary` it is deleted at the end; with outlive only at the end of the one around it, if there is one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_OPEN) > outlive:
        _OPEN[-1 - outlive].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that materialize has written within it, but for those that outlive it. What is read
    later must not depend on them."""
    _OPEN.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _OPEN.pop():
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What is run within it hands its workers Arrow batches of about `size` bytes, one row at least, instead of 10,000
    rows of any length: a batch lies in the executor's JVM, in its worker, and there once more as Python strings."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def tidy(run: Callable, *caches: Callable[[], object]) -> Callable:
    """run, a function of Arrow batches, for mapInArrow; when its task ends `caches` are emptied and freed memory goes
    back to the system. Workers live on between tasks and stages, so what they keep would add up on an executor."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            for clear in caches:
                clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return tidied


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as bucket 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % F.lit(modulus), F.lit(0))
