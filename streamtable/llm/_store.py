"""Keeps results that are read more than once: in Parquet files of the folder that all executors share, which cuts lineage, or on the executors' disks. Keeps Python workers small."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_held: list[DataFrame] = []
_kept: list[tuple] = []  # of a Python worker


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one, which only a local master can share."""
    if folder := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='streamtable-')}"
    spark.sparkContext._conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df, written once and read again: a lost executor costs no recomputation before this point."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/streamtable/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """df, computed once and kept on the executors' disks. What a lost executor had is computed again, and nothing else.

    Hadoop's local file system starts a program (chmod) for each file and folder that it makes, and until that has begun, the child counts as
    a second JVM of the same size. Results of many tasks are therefore held, those with a long lineage are stored().
    """
    _held[:] = [x for x in _held if x.storageLevel.useDisk]  # with what clearCache() has let go, its plans and shuffles go
    df = df.persist(StorageLevel.DISK_ONLY)
    _held.append(df)
    df.count()
    return df


def bare(df: DataFrame) -> DataFrame:
    """df, of a result that is held, as a leaf of later plans: rows, size and partitioning only.

    The plan of a held result holds the plans of all that it was made from, as often as each was read, and the driver keeps, prints and compiles
    them anew for every query on it. The leaf's rows come from the same blocks, and a lost executor's share is computed again as before.
    """
    spark = df.sparkSession
    sql = spark._jvm.org.apache.spark.sql
    leaves = getattr(getattr(sql.execution, "LogicalRDD$"), "MODULE$")
    leaf = leaves.fromDataset(df._jdf.queryExecution().toRdd(), df._jdf, False)
    return DataFrame(sql.classic.Dataset.ofRows(spark._jsparkSession, leaf), spark)


def release() -> None:
    """Deletes what stored() and held() have kept in this process. Call it once the results have been written; it also runs at exit."""
    while _held:
        df = _held.pop()
        try:
            df.unpersist()
        except Exception:  # the session may have gone, and all that it held with it
            continue
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have gone; the folder's owner then clears it
            return


atexit.register(release)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows and bytes, as rows hold whole documents of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def kept(key, make: Callable):
    """make(), which this Python worker keeps for its next tasks, until it has a tidy() one that doesn't use what is kept."""
    if not _kept or _kept[0][0] != key:
        _kept[:] = [(key, make())]
    return _kept[0][1]


def forget() -> None:
    _kept.clear()


def give_back() -> None:
    """Gives memory that is free, but still this process's, back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def tidy(run: Callable, keeps: bool = False) -> Callable:
    """run, a function for mapInArrow, with less left in its Python worker. keeps: run uses what is kept().

    Spark takes Python workers in turn and keeps them for as long as it runs, so each comes to hold the most that any of its tasks
    has needed, beside the memory of the executor's JVM.
    """

    def whole(batches):
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def deal(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
