"""Lines that many documents share are dropped from all of them.

Lines are normalised, hashed to 128 bits, counted by distinct documents, and
the texts are put together again from the lines that stay, in their order.

Each row counts as one document: repeated rows are documents of their own, and
rows with a null id are documents too. A null text is one empty line, as is an
empty text. Empty keys never count, so empty lines always stay (``min_chars``).
Texts of any length are read whole. Other columns stay as they are, but for
those that have the names of the new ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import by_batch, table, utf8, without
from helixframe.plans.scratch import counted, cut

#: Lines that are sent to all tasks, at most: 4 MB.
MANY = 1 << 18
#: Stripped from both ends of a line's key.
WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()  # bytes.lower() changes A-Z only


def _counted(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _row_key(text: str, id_col: str):
    """Equal for rows of equal id and text; should others meet, they only share a list of lines to look up."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))


def line_hashes(df: DataFrame, *, text: str = "text", id_col: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """(k, h1, h2): a row for each distinct key in each row of ``df``."""

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        parts, counts = [], []
        for t in utf8(b.column(1)):
            found = {xxhash.xxh3_128_digest(x) for x in map(line_key, set(t.split(b"\n"))) if _counted(x, min_chars)}
            counts.append(len(found))
            parts.extend(found)
        h = np.frombuffer(b"".join(parts), dtype="<i8").reshape(-1, 2)
        k = np.repeat(b.column(0).to_numpy(zero_copy_only=False), counts)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["k", "h1", "h2"])

    return by_batch(df.select(_row_key(text, id_col).alias("k"), F.col(text)), emit, "k long, h1 long, h2 long")


def drop_common_lines(df: DataFrame, *, text: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``df`` with ``text`` rebuilt, and the columns ``n_lines`` and ``n_dropped``; columns of those names are replaced.

    The hashes are written once; counting them combines before the shuffle, so
    a line of every document weighs no more than another. The counts that reach
    the threshold are written too, and only these hashes come back to the rows
    they are from: those of the most frequent lines, ``MANY`` at most whatever the
    table, are sent to all tasks, so that no line's rows meet anywhere; of the
    others none has more than one in ``MANY`` of all rows. A row's own such hashes
    form its list: no list is longer than a text.
    """
    seen, all_ = counted(line_hashes(df, text=text, id_col=id_col, min_chars=min_chars), "lines")
    common = cut(seen.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs), "common")
    # No more than MANY lines can be in more than this share of all rows.
    limit = all_["n"] // MANY
    most = seen.join(F.broadcast(common.filter(F.col("n") > limit).select("h1", "h2")), ["h1", "h2"])
    rest = seen.join(common.filter(F.col("n") <= limit).select("h1", "h2").hint("merge"), ["h1", "h2"])
    own = most.unionByName(rest).groupBy("k").agg(F.collect_set(F.struct("h1", "h2")).alias("hs"))
    own = own.select(F.col("k").alias("__k"), F.col("hs").alias("__hs"))
    keep = without(df, "n_lines", "n_dropped")
    joined = df.select(*[F.col(f"`{c}`") for c in keep], _row_key(text, id_col).alias("__k")).join(own, "__k", "left").drop("__k")
    at = keep.index(text)

    def rebuild(b: pa.RecordBatch) -> pa.RecordBatch:
        out, lines, dropped = [], [], []
        hs = b.column(b.num_columns - 1)
        pairs = hs.flatten()
        raw = np.empty((len(pairs), 2), "<i8")
        for j in (0, 1):
            raw[:, j] = pairs.field(j).to_numpy(zero_copy_only=False)
        raw, o = raw.tobytes(), 0
        for t, n in zip(utf8(b.column(at)), hs.value_lengths().fill_null(0).to_pylist(), strict=True):
            split = t.split(b"\n")
            lines.append(len(split))
            if n:
                drop = {raw[16 * i : 16 * i + 16] for i in range(o, o + n)}
                kept = [x for x in split if not _counted(y := line_key(x), min_chars) or xxhash.xxh3_128_digest(y) not in drop]
                dropped.append(len(split) - len(kept))
                out.append(b"\n".join(kept))
            else:
                dropped.append(0)
                out.append(t)
            o += n
        texts = pa.array(out, pa.binary()).cast(pa.string())
        columns = [texts if i == at else b.column(i) for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*keep, "n_lines", "n_dropped"])

    schema = joined.drop("__hs").schema.add("n_lines", "long").add("n_dropped", "long")
    return by_batch(joined, rebuild, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 1 code point that 10 documents or more hold go, from every one."""
    kept = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
  SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split
), keyed AS (
  SELECT r, doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT d.r, d.doc_id, d.line, d.pos, c.k IS NOT NULL AS gone FROM keyed d LEFT JOIN common c ON d.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
