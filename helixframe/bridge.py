"""Deterministic reads from the driver's ``documents``: their letters, mapped to bases, cut into overlapping windows.

Every letter of every document takes part. Windows start every 7 letters;
every other one is turned to the other strand, and neighbouring windows are
mates. The last windows of a document are shorter, and z is no base, so the
filters have something to do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.scratch import spread
from helixframe.plans.ship import arrow

READ_LEN, STEP, K = 36, 7, 21
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAN"


#: Reads of a batch that a task makes at once.
AT_ONCE = 1 << 16
_BASE = np.zeros(256, np.uint8)
_BASE[list((ALPHABET + ALPHABET.upper()).encode())] = list((BASES * 2).encode())
_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[list(b"ACGT")] = list(b"TGCA")


def _cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(read_id, seq) of (name, text): the windows of all texts of a batch, cut together."""
    for b in batches:
        text = b.column(1).cast(pa.binary())
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        if not len(text) or offsets[0] == offsets[-1]:
            continue
        s = _BASE[np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
        ends = np.concatenate(([0], np.cumsum(s > 0)))[offsets - offsets[0]]
        s = s[s > 0]
        n = -(-np.diff(ends) // STEP)
        last = np.cumsum(n)
        for at in range(0, int(last[-1]), AT_ONCE):
            no = np.arange(at, min(at + AT_ONCE, int(last[-1])))
            own = np.searchsorted(last, no, "right")
            w = no - (last[own] - n[own])
            begin = ends[own] + STEP * w
            size = np.minimum(READ_LEN, ends[own + 1] - begin)
            turned = w % 2 == 1
            to = np.concatenate(([0], np.cumsum(size)))
            # A turned window is read from its last letter on.
            first, step = np.where(turned, begin + size - 1, begin), np.where(turned, -1, 1)
            bases = s[np.repeat(first - step * to[:-1], size) + np.repeat(step, size) * np.arange(to[-1])]
            bases = np.where(np.repeat(turned, size), _OTHER[bases], bases)
            seq = pa.StringArray.from_buffers(len(no), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(bases))
            name = b.column(0).take(pa.array(own))
            made = pc.binary_join_element_wise("d", name, "p", pa.array(w // 2).cast(pa.string()), "_", pa.array(1 + w % 2).cast(pa.string()), "")
            yield pa.RecordBatch.from_arrays([made, seq], ["read_id", "seq"])


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq)."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return arrow(docs.select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text")), _cut_up, "read_id string, seq string")


#: The same in DuckDB's SQL.
RAW_SQL = f"""letters AS (
  SELECT doc_id, translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{BASES}') AS s FROM documents
), raw AS (
  SELECT 'd' || doc_id || 'p' || (i // {2 * STEP}) || '_' || (1 + (i // {STEP}) % 2) AS read_id,
         CASE WHEN (i // {STEP}) % 2 = 1 THEN reverse(translate(substr(s, i + 1, {READ_LEN}), 'ACGT', 'TGCA')) ELSE substr(s, i + 1, {READ_LEN}) END AS seq
  FROM letters, range(0, length(s), {STEP}) t(i)
)"""
