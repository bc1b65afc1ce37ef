"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Each text becomes a sparse vector: hashed words weighted by damped counts and
brought to length one, and one bin for each statistic of its structure (and of
its length, the only metadata that isn't a label). The machine's score is the
logistic function of a bias, linear weights, and the products of low-rank
factors for all pairs of features, summed in linear time as half of the square
of the sum less the sum of squares.

The model is fitted on the driver on at most ``max_rows`` labelled documents,
those of the least hashes of their ids (of repeated ids, each row is one);
everything else covers all rows. Without labels of both kinds every score is the
share of label 1 (0.5 without labels).

Null and empty texts are scored by their bins alone. Labels that are null, or
whose id is, are not used; of repeated labels each counts. Each row of the
documents gives a row. Texts of any length are read whole. Other columns stay
as they are, but for one that has the name of the score.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import by_batch, table, utf8, without

#: Hashed words; the bins of the statistics come after them.
WORDS = 1 << 14
BINS = 10
#: Statistics in [0, 1] are cut at these into bins; counts at powers of 4.
SHARES = np.array([1e-9, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.7, 0.9])
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
SPACES = b" \t\n\x0b\x0c\r"
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?!")
AROUND = MARKS + b".,;:'\"-()?!"
N_STATS = 11
#: Words whose places are kept in a worker.
KEPT = 1 << 18
#: Entries of vectors that are scored at once: as many as a core has near.
AT_ONCE = 1 << 13


def statistics(text: bytes, words: list[bytes], counts: Counter) -> tuple[list[float], list[int]]:
    """Shares and counts that describe a text's structure."""
    n, m = max(1, len(text)), max(1, len(words))
    lines = text.split(b"\n")
    letters = len(text) - len(text.translate(None, SPACES + DIGITS + MARKS))
    shares = [
        (len(text) - len(text.translate(None, UPPER))) / max(1, n - letters),
        (len(text) - len(text.translate(None, DIGITS))) / n,
        (len(text) - len(text.translate(None, MARKS))) / n,
        text.count(b"|") / m,
        text.count(b"!") / m,
        sum(map(eq, words, words[1:])) / m,
        1 - len(counts) / m,
        1 - len(set(lines)) / len(lines),
        (max(counts.values()) if counts else 0) / m,
    ]
    return shares, [len(words), n // m]


class Slots(dict):
    """The place of each word: hashed without its case and the marks around it. Words of a text come again in others, so they are kept, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        place = xxhash.xxh32_intdigest(word.lower().strip(AROUND), 7) & (WORDS - 1)
        if len(word) <= 32:
            if len(self) >= KEPT:
                self.clear()
            self[word] = place
        return place


SLOTS = Slots()


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's vector; no place twice."""
    words = text.split()
    counts = Counter(words)
    shares, sizes = statistics(text, words, counts)
    slot = np.fromiter(map(SLOTS.__getitem__, counts), np.int64, len(counts))
    place, back = np.unique(slot, return_inverse=True)
    value = np.log1p(np.bincount(back, weights=np.fromiter(counts.values(), np.float64, len(counts)), minlength=len(place)))
    value /= max(1e-9, float(np.sqrt((value**2).sum())))
    bins = [*np.searchsorted(SHARES, shares, "right").tolist(), *(min(BINS - 1, int(x).bit_length() // 2) for x in sizes)]
    more = WORDS + BINS * np.arange(N_STATS) + np.array(bins)
    return np.concatenate((place, more)), np.concatenate((value, np.full(N_STATS, 0.5)))


class Machine:
    """Weights, and scores of many vectors: ``at`` has each vector's first place."""

    def __init__(self, size: int, rank: int, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, rank))

    def raw(self, place: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[place] * value[:, None]
        total = np.add.reduceat(vx, at)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, at)).sum(1)
        return self.bias + np.add.reduceat(self.w[place] * value, at) + pairs, total

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of vectors (places, values), all in one go; a vector has a place for each statistic, so none is empty."""
        if not rows:
            return np.zeros(0)
        at = np.cumsum([0, *(len(p) for p, _ in rows[:-1])])
        place, value = (np.concatenate(x) for x in zip(*rows, strict=True))
        return 1 / (1 + np.exp(-np.clip(self.raw(place, value, at)[0], -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, rank: int = 8, epochs: int = 8, batch: int = 128, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss, steps scaled by the root of the squared gradients so far."""
    size = WORDS + BINS * N_STATS
    m = Machine(size, rank, seed)
    share = float(labels.mean()) if len(labels) else 0.5
    m.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if len(labels) == 0 or labels.min() == labels.max():
        m.v[:] = 0
        return m
    rng = np.random.default_rng(seed)
    gw, gv, gb = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            chosen = order[i : i + batch]
            lengths = np.array([len(rows[k][0]) for k in chosen])
            at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            place = np.concatenate([rows[k][0] for k in chosen])
            value = np.concatenate([rows[k][1] for k in chosen])
            raw, total = m.raw(place, value, at)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(chosen)
            each = np.repeat(slope, lengths) * value
            d = np.bincount(place, weights=each, minlength=size) + decay * m.w
            gw += d * d
            m.w -= rate * d / np.sqrt(gw)
            inner = (np.repeat(total, lengths, axis=0) - m.v[place] * value[:, None]) * each[:, None]
            for f in range(rank):
                d = np.bincount(place, weights=inner[:, f], minlength=size) + decay * m.v[:, f]
                gv[:, f] += d * d
                m.v[:, f] -= rate * d / np.sqrt(gv[:, f])
            d = float(slope.sum())
            gb += d * d
            m.bias -= rate * d / gb**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", label: str = "quality", max_rows: int = 8000) -> Machine:
    """Fits on at most ``max_rows`` labelled rows. The vectors are made where the texts are; a vector has WORDS + 11 places at most, however long its text."""
    sample = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label).cast("int").alias("__y"))
    sample = sample.orderBy(F.xxhash64(id_col), id_col, "__y").limit(max_rows)
    joined = docs.select(id_col, text).join(F.broadcast(sample), id_col).select(F.col(id_col).cast("string").alias("id"), "__y", text)

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in utf8(b.column(2))]
        columns = [b.column(0), b.column(1), pa.array([x.astype("<i4").tobytes() for x, _ in found], pa.binary()), pa.array([y.astype("<f4").tobytes() for _, y in found], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "y", "place", "value"])

    got = by_batch(joined, emit, "id string, y int, place binary, value binary").orderBy(F.xxhash64("id"), "id", "y", "place").limit(max_rows).collect()
    rows = [(np.frombuffer(r.place, "<i4").astype(np.int64), np.frombuffer(r.value, "<f4").astype(np.float64)) for r in got]
    return fit(rows, np.array([r.y for r in got], np.float64))


def score(df: DataFrame, model: Machine, *, text: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the column ``score`` (replaced, if there), 0 to 1."""
    keep = without(df, score_col)
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, out, held, size = shared.value, [], [], 0
        for t in utf8(b.column(at)):
            held.append(features(t))
            size += len(held[-1][0])
            if size >= AT_ONCE:
                out.append(m.scores(held))
                held, size = [], 0
        out.append(m.scores(held))
        out = np.concatenate(out)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*keep, score_col])

    return by_batch(df, run, T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    found = score(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
