"""Context-triggered piecewise hashing: fingerprints that stay alike when a text is edited.

A rolling hash over 8 bytes marks boundaries where its last k bits are ones, so
boundaries depend on their neighbourhood alone. Each chunk between boundaries
gives one of 64 letters. k is the block size's exponent: as for a signature of
32 to 64 letters. A fingerprint is ``k:signature at k:signature at k + 1``, and
two are compared where a block size is in both: by the edits (insertions and
deletions) between the signatures, as a share of their letters. Where a level
has far more boundaries than letters, as in a text that repeats one passage,
letters stand for as many chunks each as are needed to cover the whole text.

Null and empty texts have the fingerprint ``2::``; equal fingerprints are alike
by 1, and a signature without letters like no other. Signatures that share no
run of 5 letters (of half their letters, if the shorter one has fewer than 10)
are not alike at all. Texts of any length have such a fingerprint.

``with_next`` gives each row the next row's text: rows are ordered by id (nulls
first), rows of equal ids by their texts, and the first follows the last. Each
row gives a row, repeated ones alike. Columns other than id and text are left
out, so their names clash with none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table

LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LEAST = 2
LONGEST = 64
COMMON = 5


def _scatter() -> np.ndarray:
    """A 32-bit number for each byte."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray, scattered: np.ndarray) -> np.ndarray:
    """The hash of the 8 bytes that end at each byte from the eighth on: pairs of 1, 2 and 4 bytes are put together."""
    r = scattered[data]
    for step, factor in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F)):
        r = r[:-step] * np.uint32(factor) + r[step:]
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x2C1B3C6D)
    return r ^ (r >> np.uint32(13))


def signature(text: bytes, ends: np.ndarray) -> str:
    """A letter for each chunk; the last one takes the rest. Of more than twice as many chunks, neighbours are put together."""
    if len(ends) >= 2 * LONGEST:
        ends = ends[np.arange(1, LONGEST) * len(ends) // LONGEST]
    at = [0, *ends[: LONGEST - 1].tolist()]
    if at[-1] < len(text):
        at.append(len(text))
    return bytes(LETTERS[(h ^ h >> 13 ^ h >> 21) & 63] for h in (zlib.crc32(text[a:b]) for a, b in zip(at, at[1:], strict=False))).decode()


def fingerprint(text: bytes, scattered: np.ndarray | None = None) -> str:
    if not text:
        return f"{LEAST}::"
    k = max(LEAST, (len(text) // LONGEST).bit_length())
    if len(text) < 8:
        ends = level = np.empty(0, np.int64)
    else:
        r = rolling(np.frombuffer(text, np.uint8), _scatter() if scattered is None else scattered)
        ends = np.flatnonzero((r & np.uint32((1 << LEAST) - 1)) == (1 << LEAST) - 1)
        level = r[ends]
        ends += 8

    def at(k: int) -> np.ndarray:
        mask = np.uint32((1 << k) - 1)
        return ends[(level & mask) == mask] if len(ends) else ends

    while k > LEAST and len(at(k)) < LONGEST // 2:
        k -= 1
    return f"{k}:{signature(text, at(k))}:{signature(text, at(k + 1))}"


def _letters(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, signatures), np.int64, len(signatures))
    out = np.zeros((len(signatures), LONGEST), np.uint8)
    out[np.arange(LONGEST) < size[:, None]] = np.frombuffer("".join(signatures).encode(), np.uint8)
    return out, size


def common_length(a: list[str], b: list[str]) -> np.ndarray:
    """The longest common subsequence of each pair, all pairs at once: a row of the table is the bits of one number."""
    x, _ = _letters(a)
    y, size = _letters(b)
    weights = np.uint64(1) << np.arange(LONGEST, dtype=np.uint64)
    v = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(int(size.max(initial=0))):
        m = np.where(x == y[:, j, None], weights, np.uint64(0)).sum(1, dtype=np.uint64)
        m[size <= j] = 0
        u = v & m
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def _shares_run(a: str, b: str) -> bool:
    n = min(COMMON, max(2, min(len(a), len(b)) // 2))
    runs = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in runs for i in range(len(b) - n + 1))


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; the better one where two block sizes are in both."""
    out = np.zeros(len(pairs))
    jobs: list[tuple[int, str, str]] = []
    for i, (f, g) in enumerate(pairs):
        if f == g:
            out[i] = 1.0
            continue
        (k, f1, f2), (m, g1, g2) = f.split(":"), g.split(":")
        for a, b in {0: ((f1, g1), (f2, g2)), 1: ((f1, g2),), -1: ((f2, g1),)}.get(int(k) - int(m), ()):
            if a and b and (a == b or _shares_run(a, b)):
                jobs.append((i, a, b))
    for s in range(0, len(jobs), 4096):
        at, a, b = zip(*jobs[s : s + 4096], strict=True)
        total = np.fromiter(map(len, a), np.int64) + np.fromiter(map(len, b), np.int64)
        np.maximum.at(out, np.array(at), 2 * common_length(list(a), list(b)) / total)
    return out


def with_next(df: DataFrame, f: Callable[[list[tuple]], pa.RecordBatch], schema: str, *, text: str = "text", id_col: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """``f`` on lists of (id, text, next text).

    Rows are dealt to ranges of ids, cut at quantiles, in one exchange of the
    texts. A range's last row needs the first row of the next range: these few
    rows, one for each range, are dealt to the range before as well. Tasks go
    through their rows in order and hold one row beside the batch.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    share = [i / buckets for i in range(1, buckets)]
    cuts = np.unique(np.array(source.approxQuantile("id", share, 1 / (8 * buckets)) if share else [], np.float64)).astype(np.int64)

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(cuts, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right")
        return pa.array(at, pa.int32())

    low = F.coalesce(F.col("id"), F.lit(-(2**63)))
    firsts = {r.b: r.low for r in source.select("id").withColumn("b", bucket("id")).groupBy("b").agg(F.min(low).alias("low")).collect()}  # one row for each range
    if not firsts:
        return spark.createDataFrame([], schema)
    order = sorted(firsts)
    before = {firsts[b]: order[i - 1] for i, b in enumerate(order)}
    at = spark.createDataFrame([(int(k), int(v)) for k, v in before.items()], "low long, b int")
    edge = source.withColumn("low", low).join(F.broadcast(at), "low").groupBy("b").agg(F.min(F.struct(low.alias("low"), F.col("text"))).alias("x"))
    rows = source.select(bucket("id").alias("b"), F.lit(0).alias("edge"), "id", "text")
    edges = edge.select("b", F.lit(1).alias("edge"), F.lit(None).cast("long").alias("id"), F.col("x.text").alias("text"))
    dealt = rows.unionByName(edges).repartitionById(buckets, "b").sortWithinPartitions("b", "edge", F.asc_nulls_first("id"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                done = []
                for edge, doc, t in zip(*(c.to_pylist() for c in batch.slice(s, 512).columns[1:]), strict=True):
                    if held:
                        done.append((*held, t))
                    held = None if edge else (doc, t)
                if done:
                    yield f(done)

    return dealt.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(df: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint) of each row's text."""
    from helixframe.llm.common import by_batch, utf8

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        scattered = _scatter()
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, scattered) for t in utf8(b.column(1))], pa.string())], [id_col, "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return by_batch(df.select(id_col, text), emit, f"`{id_col}` {kind}, fingerprint string")


OP4 = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its edited text and against the next document."""

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        scattered = _scatter()
        made = {}
        ids, sizes, hashes, own, other, follow = [], [], [], [], [], []
        for doc, t, n in rows:
            e = edited(t, n).encode()
            ids.append(doc)
            sizes.append(len(t))
            hashes.append(hashlib.sha256(e).hexdigest())
            for x in (t, n):
                if x not in made:
                    made[x] = fingerprint(x.encode(), scattered)
            own.append(made[t])
            other.append(fingerprint(e, scattered))
            follow.append(made[n])
        near = likeness([*zip(own, other, strict=True), *zip(own, follow, strict=True)])
        columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes), pa.array(own), pa.array(other), pa.array(near[: len(rows)]), pa.array(near[len(rows) :])]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OP4.split(", ")])

    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), compare, OP4)
