"""Whitening of embeddings: moments merged by Chan's formula, components from one eigendecomposition, and a second pass that checks them.

Entries become integers on a lattice, x = floor(scale * c) + offset, so counts
and sums are exact whatever the partitions. Each task works out the count, the
sums and the scatter about its own mean; two such summaries merge by

    M = Ma + Mb + (na * nb / (na + nb)) * d d',   d = mean b - mean a,

with d worked out from the exact sums, pair by pair up a tree of tasks. What
reaches the driver is one summary: the square of the dimensions in doubles,
however many rows there are. The components are the unit eigenvectors of the
covariance (divisor n), by falling eigenvalue, each with its entry of largest
size positive. A second pass merges the moments of the whitened rows in the same
way and tells how far their covariance is from the identity.

Rows go whose vector is null, empty, or holds a null, a NaN or an infinity, and
rows whose vector hasn't the length that most have (of equally many, the longer).
Components without variance, beyond rounding, are left out, as nothing can be
divided by it: a table of one row, or of rows alike, has none. Null and repeated
ids are rows like any others. Other columns stay as they are, but for those that
have the names of the new ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import by_batch, fresh, small_batches, table, without

SCALE, OFFSET = 64, 1_000_000
#: Depth of the tree of merges; rows of a block of a scatter.
DEPTH, BLOCK = 3, 4096


@dataclass
class Moments:
    """Count, sums (exact Python integers, or doubles), and scatter about the mean."""

    n: int
    s: np.ndarray
    m: np.ndarray


def of_block(x: np.ndarray) -> Moments:
    """Moments of a block's rows; integers are centred before anything is rounded."""
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    left = c.sum(0)
    return Moments(n, s.astype(object) if s.dtype.kind == "i" else s, c.T @ c - np.outer(left, left) / n)


def merge(a: Moments | None, b: Moments | None) -> Moments | None:
    """Of two sets of rows taken together."""
    if a is None or b is None:
        return b if a is None else a
    d = ((b.s * a.n - a.s * b.n) / (a.n * b.n)).astype(float)
    return Moments(a.n + b.n, a.s + b.s, a.m + b.m + np.outer(d, d) * (a.n * b.n / (a.n + b.n)))


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(df: DataFrame, column: str, rows: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Moments | None:
    """Moments of what ``rows`` makes of a column of lists of one length; none of no rows."""
    small_batches(df.sparkSession)

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                own = merge(own, of_block(rows(_matrix(b.column(0).slice(i, BLOCK)))))
        if own is not None:
            exact = own.s.dtype == object
            whole = [str(int(x)) if exact else float(x).hex() for x in own.s]
            yield pa.RecordBatch.from_arrays([pa.array([own.n]), pa.array([exact]), pa.array([whole], pa.list_(pa.string())), pa.array([own.m.tobytes()], pa.binary())], ["n", "exact", "s", "m"])

    parts = df.select(column).mapInArrow(local, "n long, exact boolean, s array<string>, m binary").rdd.map(_summary)
    return parts.treeAggregate(None, merge, merge, DEPTH) if parts.getNumPartitions() else None


def _summary(r: T.Row) -> Moments:
    s = np.array([int(x) for x in r.s], object) if r.exact else np.array([float.fromhex(x) for x in r.s])
    return Moments(r.n, s, np.frombuffer(r.m).reshape(len(s), len(s)))


@dataclass
class Whitening:
    """What makes a row white: n, the exact sums, unit eigenvectors as columns, their eigenvalues, and the covariance's trace."""

    n: int
    s: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def white(self, x: np.ndarray) -> np.ndarray:
        return self._centred(x) / self.n @ self.axes / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        return (self._centred(x) ** 2).sum(1)

    def _centred(self, x: np.ndarray) -> np.ndarray:
        return self.n * x - self.s


def components(found: Moments, most: int) -> Whitening:
    """The ``most`` leading components at most."""
    v = found.m / found.n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    some = (values > len(values) * np.finfo(float).eps * max(values[0], 0.0)) & (np.arange(len(values)) < most)
    axes = axes[:, some] * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(values))])[some]
    return Whitening(found.n, found.s.astype(np.int64), axes, values[some], float(np.trace(v)))


def finite(vector: str) -> Column:
    """Is there a vector, and is each of its entries a finite number?"""
    each = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= 1.7976931348623157e308, F.lit(False)))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & each, F.lit(False))


def whiten(df: DataFrame, vector: str, most: int = 32, *, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, Whitening | None, float]:
    """``df``'s remaining rows with deviation (the sum of the squares of n * x - s) and whitened (an entry for each component); what was fitted; and the largest entry of the whitened rows' covariance less the identity."""
    keep = without(df, "deviation", "whitened")
    whole = T.StructType([*df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    good = df.filter(finite(f"`{vector}`"))
    size = good.groupBy(F.size(f"`{vector}`").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return df.sparkSession.createDataFrame([], whole), None, 0.0
    x = F.transform(f"`{vector}`", lambda c: F.floor(c.cast("double") * scale).cast("long") + offset)
    own = fresh(df, "x")
    names = [*[c for c in keep if c != vector], vector]
    good = good.filter(F.size(f"`{vector}`") == size["d"]).select(*[F.col(f"`{c}`") for c in names], x.alias(own))
    model = components(moments(good, own), most)
    shared = df.sparkSession.sparkContext.broadcast(model)
    checked = moments(good, own, lambda x: shared.value.white(x)) if len(model.values) else None
    error = float(np.abs(checked.m / checked.n - np.eye(len(model.values))).max()) if checked else 0.0
    k = len(model.values)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, x = shared.value, _matrix(b.column(b.num_columns - 1))
        white = pa.ListArray.from_arrays(pa.array(np.arange(0, k * (len(x) + 1), k) if k else np.zeros(len(x) + 1), pa.int32()), pa.array(m.white(x).ravel(), pa.float64()))
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.deviation(x), pa.int64()), white], [*names, "deviation", "whitened"])

    schema = T.StructType([*good.drop(own).schema.fields, *whole.fields[-2:]])
    return by_batch(good, run, schema).select(*[F.col(f"`{c}`") for c in keep], "deviation", "whitened"), model, error


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each embedding that is left and each of 32 components at most."""
    found, model, error = whiten(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")), "embedding", 32)
    share = [float(v) / model.trace for v in model.values] if model else []
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, share or [0.0])), F.col("i") + 1)
    return each.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
