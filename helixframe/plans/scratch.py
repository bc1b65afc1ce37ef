"""Intermediate tables in the folder that the driver and all executors share.

A plan that loops, or whose result is read twice, writes the rows as Parquet
under ``spark.checkpoint.dir`` and goes on from the files: lineage is cut and
losing an executor costs nothing but the running tasks.

A table goes when no plan reads it any more. Every plan made from its scan
holds the scan's relation in the driver's JVM, so a weak reference to that tells:
once it is empty, the files are removed with the next table that is written. As
only a full collection finds old plans, one is asked for when many tables have
come together, at most once a minute; it lets Spark's own cleaner remove the
shuffle files of finished plans as well, which else fill the disks of a driver
with a large heap. What is left goes when the interpreter ends. The folders'
names begin with the application's id, by which the ones of an application that
was killed can be told.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
import weakref
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Path: the session, and a weak reference of the JVM to the relation that reads it, once there is one.
_made: dict[str, tuple[weakref.ref, Any]] = {}
#: The folder made for sessions that name none, as in tests on one machine.
_own: list[str] = []
#: Tables that come together before a full collection is asked for, and the seconds between two.
MANY, PAUSE = 16, 60
_last = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; one of our own only where it names none and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="helixframe-"))
    return f"file://{_own[0]}"


#: Rows of a file of a table whose size is known beforehand.
FILE_ROWS = 200_000


def cut(df: DataFrame, name: str = "cut", *, rows: int | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and return a scan of the files.

    ``rows``: a bound of its rows, where one is known and making them is little
    work: it is then written by as many tasks as such rows need, not by one for
    each partition of the last exchange.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = reserve(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    relation = out._jdf.queryExecution().analyzed().relation()
    _made[path] = (weakref.ref(spark), spark.sparkContext._jvm.java.lang.ref.WeakReference(relation))
    del relation
    sweep(spark)
    return out


def counted(df: DataFrame, name: str = "cut", *, rows: int | None = None, **numbers: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut``, and the rows' number n and other aggregates over them, worked out by the tasks that write them: no job of their own."""
    seen = Observation()
    out = cut(df.observe(seen, F.count("*").alias("n"), *[c.alias(k) for k, c in numbers.items()]), name, rows=rows)
    return out, {k: v or 0 for k, v in seen.get.items()}


def sweep(spark: SparkSession, *, force: bool = False) -> None:
    """Removes the tables that no plan reads any more."""
    global _last
    if force or len(_made) > MANY and time.monotonic() - _last > PAUSE:
        gc.collect()  # Python's handles keep the JVM's objects
        spark.sparkContext._jvm.java.lang.System.gc()
        _last = time.monotonic()
    for path, (ref, relation) in list(_made.items()):
        if relation is not None and ref() is spark and relation.refersTo(None):
            drop(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the cluster has cores, where its files give fewer: a single small file is one task else."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def reserve(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/helixframe-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    _made[path] = (weakref.ref(spark), None)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a reserved path by way of Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _made.pop(path, None)


def drop_all() -> None:
    for path, (ref, _) in list(_made.items()):
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:  # the session is gone; nothing is left to clean with
            _made.pop(path, None)


atexit.register(drop_all)
