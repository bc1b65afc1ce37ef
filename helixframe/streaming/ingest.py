"""Reads that arrive over time: filtered as they come, collapsed batch by batch.

The assembly itself is a batch; a stream only keeps its input ready. A batch's
reads are collapsed before they are written, each batch to a folder of its own
that a rerun of the batch overwrites, and ``nodes`` collapses the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from helixframe.functions.dna import canonical
from helixframe.operators.reads import read_dedup, read_filter


def collapse_stream(reads: DataFrame, out: str, checkpoint: str, k: int) -> DataStreamWriter:
    """The writer of a stream of (read_id, seq): good reads, equal ones of a batch as one with their number as coverage."""

    def write(batch: DataFrame, number: int) -> None:
        read_dedup(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return read_filter(reads, k).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def nodes(spark: SparkSession, out: str) -> DataFrame:
    """(node_id, seq, cov) of all batches so far."""
    parts = spark.read.parquet(out)
    own = parts.groupBy(canonical("seq").alias("c")).agg(F.min(F.struct("node_id", "seq")).alias("x"), F.sum("cov").alias("cov"))
    return own.select("x.node_id", "x.seq", "cov")
