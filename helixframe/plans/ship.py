"""The package's own files, given to the Python workers.

A worker imports this package to run its functions. Where a job wasn't started in
the repository and the package isn't installed on the executors, it couldn't;
Spark's own distribution of files sends it along, once for an application.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, if that hasn't been done."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(top):  # it came in a zip itself
        return
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "helixframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(d, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)


def arrow(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``f`` over the Arrow batches of each task, on workers that have the package."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)
