"""What the corpus operators share: Arrow passes over whole texts, output columns."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.scratch import spread
from helixframe.plans.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The column's texts; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of 8 MB where the session has the default of 64: a task holds a batch several times over.

    The setting stays for the session, as plans read it when they run; a value
    of the user's own is left as it is. The workers get the package as well.
    """
    ship(spark)
    if spark.conf.get(BATCH_BYTES, None) in ("64MB", "64m", "67108864", "67108864b"):
        spark.conf.set(BATCH_BYTES, "8388608b")


def release() -> None:
    """Gives memory that is free back to the system: a worker goes on to other tasks, and keeps what it has grown to else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 1024) -> DataFrame:
    """``f`` on up to ``rows`` rows of an Arrow batch; batches are bounded in bytes, so memory doesn't grow with a partition."""
    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield f(b.slice(i, rows))
        release()

    return df.mapInArrow(run, schema)


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` that no output column of the operator replaces."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def once_in_worker(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a Python worker and kept for its later tasks."""
    kept = sys.modules.setdefault("_helixframe_worker", types.ModuleType("_helixframe_worker"))
    if key not in vars(kept):
        vars(kept)[key] = make()
    return vars(kept)[key]
