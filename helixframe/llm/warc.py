"""WARC records and a Merkle audit of their replicas.

A page is a WARC record: header lines, a blank line, the body. Records lie in
files by ranges of 2^12 keys, ordered by key and then by hash, at the offsets
that the lengths before them add up to; ``write_warc`` writes these files. A
node stands for a range of a file's bytes: it is the hash of the hashes and the
lengths of its parts in their order, from a key's records through up to 64
neighbours, level by level up to one root. Two replicas are compared from the
root down, and a level's nodes are looked at only below a node that differed,
so work after hashing follows the damage and not the archive.

A null url or html is the empty text. A null key is replaced by a negative one
made from the record. Records of equal keys share a leaf: their distinct hashes
with their counts, in order, put together from parts by the hashes' first
digits, so a key of a third of all records is dealt out; a repeated
record that one replica has less often is reported. Records lost and records
added are reported with a null hash on the side that lacks them. Bodies of any
length stay in the task that reads them. Other columns of the pages are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table
from helixframe.plans.scratch import cut

#: Children of a node, as bits of the key; keys of a file, likewise.
FANOUT_BITS = 6
FILE_BITS = 12
#: Hex digits of a record's hash by which a key's records are dealt to parts.
PART_DIGITS = 3


def record(key: Column, url: Column, html: Column) -> Column:
    """A page as a WARC record, without the two line ends that follow it in a file."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body)


def _key(key: str, whole: Column) -> Column:
    return F.coalesce(F.col(key).cast("long"), -1 - F.shiftrightunsigned(F.xxhash64(F.lit(0), whole), 24))


def leaves(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(k, id, size, sha, n): a row for each distinct record of each key; n counts its repeats. Bodies never leave their task."""
    whole = record(F.col(key), F.col(url), F.col(html))
    hashed = pages.select(_key(key, whole).alias("k"), F.col(key).cast("long").alias("id"), (F.octet_length(whole) + 4).cast("long").alias("size"), F.sha2(whole, 256).alias("sha"))
    return hashed.groupBy("k", "id", "size", "sha").agg(F.count("*").alias("n"))


def _joined(*child: str) -> tuple[Column, Column]:
    """(h, bytes) of a node: the hash of its children's hashes and lengths in their order, and the sum of the lengths."""
    ordered = F.array_sort(F.collect_list(F.struct(*child, "h", "bytes")))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x["h"], F.lit(":"), x["bytes"].cast("string"))), ""), 256).alias("h"), F.sum("bytes").alias("bytes")


def _part() -> Column:
    return F.left("sha", F.lit(PART_DIGITS)).alias("part")


def _leaves(records: DataFrame) -> DataFrame:
    """(k, h, bytes) of each key, from its parts."""
    each = records.select("k", _part(), F.concat("sha", F.lit(":"), F.col("n").cast("string")).alias("h"), (F.col("size") * F.col("n")).alias("bytes"))
    return each.groupBy("k", "part").agg(*_joined()).groupBy("k").agg(*_joined("part"))


def _nodes(children: DataFrame, bits: int) -> DataFrame:
    """(k, h, bytes) of the level above: keys without their last ``bits``. A node has at most 2^bits children."""
    return children.withColumnRenamed("k", "c").groupBy(F.shiftright("c", bits).alias("k")).agg(*_joined("c"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels of (k, h, bytes) from the leaves' to the root's; each is written, as both the level above and the audit read it."""
    levels = [cut(_leaves(leaf), "leaves")]
    while True:
        low, high, size = levels[-1].agg(F.min("k"), F.max("k"), F.count("*")).first()
        if low is None or low == high and low in (0, -1):
            return levels
        levels.append(cut(_nodes(levels[-1], FANOUT_BITS), "nodes", rows=size))
        if low < 0 <= high and high >> FANOUT_BITS == 0 and low >> FANOUT_BITS == -1:
            return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("k", "h").join(b.select("k", F.col("h").alias("h2")), "k", "full_outer")
    return both.filter(~F.col("h").eqNullSafe(F.col("h2"))).select("k")


def differing_keys(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """Keys whose leaves differ, found from the top level that both trees have."""
    top = min(len(a), len(b)) - 1
    bad = _differing(a[top], b[top])
    for x, y in zip(a[:top][::-1], b[:top][::-1], strict=True):
        parents = cut(bad, "damaged", rows=x.count() + y.count()).withColumnRenamed("k", "p")
        below = [t.withColumn("p", F.shiftright("k", FANOUT_BITS)).join(parents, "p", "left_semi").select("k", "h") for t in (x, y)]
        bad = _differing(*below)
    return bad


def audit(primary: DataFrame, replica: DataFrame, **columns: str) -> DataFrame:
    """A row for each record that one replica has and the other hasn't, or has more often.

    id, file_no, record_offset and record_length (in the primary's file; null
    for records it lacks), sha256 and replica_sha256, and the roots of the
    file's tree in both.
    """
    from pyspark.sql import Window

    own, other = (cut(leaves(x, **columns), "records") for x in (primary, replica))
    a, b = tree(own), tree(other)
    keys = cut(differing_keys(a, b), "keys")
    files = keys.select(F.shiftright("k", FILE_BITS).alias("f")).distinct()
    left = own.join(keys, "k", "left_semi").join(_offsets(own, a[0], files, keys), ["k", "sha"]).select("k", "id", "sha", "size", "n", "at")
    right = other.join(keys, "k", "left_semi").select("k", F.col("id").alias("id2"), F.col("sha").alias("sha2"), F.col("n").alias("n2"))
    # Records of a key are matched by hash; what is left over on either side is paired in order.
    lost = left.join(right, (left.k == right.k) & (left.sha == right.sha2) & (left.n <= right.n2), "left_anti")
    added = right.join(left, (left.k == right.k) & (left.sha == right.sha2) & (left.n >= right.n2), "left_anti")
    number = F.row_number()
    lost = lost.withColumn("i", number.over(Window.partitionBy("k").orderBy("sha")))
    added = added.withColumn("i", number.over(Window.partitionBy("k").orderBy("sha2")))
    paired = lost.join(added, ["k", "i"], "full_outer").withColumn("f", F.shiftright("k", FILE_BITS))
    # A file's root is the node that stands FILE_BITS above its leaves.
    level = FILE_BITS // FANOUT_BITS
    roots = [_root(t, level).select("k", F.col("h").alias(name)) for t, name in ((a, "file_root"), (b, "replica_root"))]
    for r in roots:
        paired = paired.join(r.withColumnRenamed("k", "f"), "f", "left")
    return paired.select(F.coalesce("id", "id2").alias("id"), F.col("f").alias("file_no"), F.col("at").alias("record_offset"), F.col("size").alias("record_length"), F.col("sha").alias("sha256"), F.col("sha2").alias("replica_sha256"), "file_root", "replica_root")


def _offsets(records: DataFrame, keyed: DataFrame, files: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, sha, at): where each record of ``keys`` begins in its file: after the file's keys before its own, its key's parts before its own, and its part's records before it."""
    from pyspark.sql import Window

    def before(name: str, *by: str) -> Column:
        return F.coalesce(F.sum("bytes").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(name)

    in_file = keyed.withColumn("f", F.shiftright("k", FILE_BITS)).join(files, "f", "left_semi").select("k", before("a1", "f", "k"))
    own = records.join(keys, "k", "left_semi").select("k", "sha", _part(), (F.col("size") * F.col("n")).alias("bytes"))
    in_key = own.groupBy("k", "part").agg(F.sum("bytes").alias("bytes")).select("k", "part", before("a2", "k", "part"))
    in_part = own.select("k", "part", "sha", before("a3", "k", "part", "sha"))
    placed = in_part.join(in_key, ["k", "part"]).join(in_file, "k")
    return placed.select("k", "sha", (F.col("a1") + F.col("a2") + F.col("a3")).alias("at"))


def _root(levels: list[DataFrame], level: int) -> DataFrame:
    t = levels[min(level, len(levels) - 1)]
    for _ in range(level - len(levels) + 1):
        t = _nodes(t, FANOUT_BITS)
    return t


def write_warc(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """The files that the audit speaks of: file_no=N holds the records of 2^FILE_BITS keys, ordered by key and hash, so a record's bytes are at the offset that is reported.

    A file is written by one task, record after record; beyond 2^FILE_BITS keys
    the archive has more files, not longer ones.
    """
    whole = record(F.col(key), F.col(url), F.col(html))
    made = pages.select(_key(key, whole).alias("k"), F.sha2(whole, 256).alias("sha"), whole.alias("value")).withColumn("file_no", F.shiftright("k", FILE_BITS))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = made.repartition(parts, "file_no").sortWithinPartitions("file_no", "k", "sha").select("file_no", "value")
    dealt.write.partitionBy("file_no").option("lineSep", "\r\n\r\n").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[int | None, str, str]]:
    """(key, url, html) of each record, by the lengths in the headers."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
        size = int(head[b"Content-Length"])
        name = head[b"WARC-Record-ID"][len(b"<urn:page:") : -1]
        yield int(name) if name else None, head[b"WARC-Target-URI"].decode(), data[end + 4 : end + 4 + size].decode()
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of the records of all files; a task holds one file's bytes at a time."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = list(parse_warc(data.as_py()))
                if rows:
                    k, u, h = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(u), pa.array(h)], ["page_id", "url", "html"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("content").mapInArrow(parse, "page_id long, url string, html string")


def damaged(pages: DataFrame) -> DataFrame:
    """The replica that the query audits: one page in 37 has its first character overwritten, one in 211 is lost."""
    html = F.coalesce(F.col("html"), F.lit(""))
    hurt = F.when(F.pmod("page_id", F.lit(37)) == 5, F.concat(F.lit("#"), F.substring(html, 2, 2**31 - 1))).otherwise(F.col("html"))
    return pages.filter(F.coalesce(F.pmod("page_id", F.lit(211)) != 7, F.lit(True))).withColumn("html", hurt)


def op10_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damage of a replica of all pages, located by their Merkle trees."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages)).withColumnRenamed("id", "page_id")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), r AS (
  SELECT page_id, url, CASE WHEN page_id % 37 = 5 THEN '#' || substr(html, 2) ELSE html END AS html FROM p WHERE page_id % 211 <> 7
), w AS (
  SELECT *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html AS rec
  FROM (SELECT 1 AS side, * FROM p UNION ALL SELECT 2 AS side, * FROM r)
), h AS (
  SELECT side, page_id AS k, strlen(rec) + 4 AS size, sha256(rec) AS sha,
         sum(strlen(rec) + 4) OVER (PARTITION BY side, page_id >> 12 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM w
), leaf AS (
  SELECT side, k, size, sha256(sha256(sha || ':1:' || size) || ':' || size) AS h FROM h
), n1 AS (
  SELECT side, k >> 6 AS k, sum(size)::BIGINT AS size, sha256(string_agg(h || ':' || size, '' ORDER BY k)) AS h FROM leaf GROUP BY side, k >> 6
), n2 AS (
  SELECT side, k >> 6 AS k, sha256(string_agg(h || ':' || size, '' ORDER BY k)) AS h FROM n1 GROUP BY side, k >> 6
)
SELECT a.k AS page_id, a.k >> 12 AS file_no, coalesce(a.before, 0)::BIGINT AS record_offset, a.size AS record_length, a.sha AS sha256, b.sha AS replica_sha256,
       x.h AS file_root, y.h AS replica_root
FROM (SELECT * FROM h WHERE side = 1) a
LEFT JOIN (SELECT * FROM h WHERE side = 2) b ON a.k = b.k
LEFT JOIN n2 x ON x.side = 1 AND x.k = a.k >> 12
LEFT JOIN n2 y ON y.side = 2 AND y.k = a.k >> 12
WHERE b.sha IS NULL OR a.sha <> b.sha
"""
