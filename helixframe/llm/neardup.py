"""Near copies by the Jaccard similarity of word shingles: SimHash first, MinHash for the rest, exact decisions, components.

SimHash (``simhash``: fingerprints, exact tables, tiles of exclusive-or and bit
counts) finds the nodes whose fingerprints differ in 3 bits or fewer. A
similarity of 0.8 can lie anywhere in the fingerprints' distances, so what these
links leave apart is looked for by MinHash.

Rows of equal shingle sets are one node. Nodes meet in the buckets of ``BANDS``
bands of ``ROWS`` MinHash values: a pair of similarity J meets in none of them
with probability (1 - J ** ROWS) ** BANDS, 3e-6 at 0.8 and less above, whatever
the length of the texts. A link is made only where the whole sets (64-bit
hashes of the shingles) have the similarity asked for, in integers.

Links are looked for twice: those of SimHash, of which a bucket gives one for
each row, with the pairs of neighbours of each MinHash bucket, and then between all
pairs of a bucket that are not of one component yet, so that a large group of
near copies doesn't cost the square of its size.
Of the latter, pairs go whose parities (of the number of shingles in each of
``CELLS`` cells) differ in more places than the sets may: the sets differ in as
many shingles at least, so no pair that should be linked goes. Buckets of more than ``tile`` rows are dealt out as pairs of tiles.

Every row takes part, repeated rows and null ids too; null texts and others
without a word are equal to each other. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import by_batch, small_batches, utf8
from helixframe.llm.components import connected_components
from helixframe.llm.simhash import fingerprints, links, pigeonhole, shingle_hashes
from helixframe.plans.scratch import cut

ROWS, BANDS = 5, 32
#: Odd factors, one for each MinHash value.
FACTORS = (np.random.default_rng(20).integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: Rows of a tile; a larger bucket is dealt out as pairs of tiles.
TILE = 2048
#: Parts of the nodes with one fingerprint.
SALTS = 64
#: Bits of a set's parities.
CELLS = 1024
#: Pairs that are sent on at once.
CHUNK = 65536


def band_hashes(h: np.ndarray) -> list[int]:
    """A number for each band, of the least values that the band's factors give."""
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for i in range(0, len(h), 2048):
        least = np.minimum(least, (FACTORS[:, None] * h[None, i : i + 2048]).min(1))
    raw = least.tobytes()
    size = 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[size * k : size * (k + 1)], k) for k in range(BANDS)] if len(h) else []


def sketches(df: DataFrame, *, text: str, shingle: int) -> DataFrame:
    """``df``, and of each row: key (of its set of shingles), n (the set's size) and bands."""

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, shingle)) for t in utf8(b.column(at))]
        bands = [np.array(band_hashes(h), np.uint64).view(np.int64) for h in sets]
        more = [pa.array([xxhash.xxh128_digest(h.astype("<u8").tobytes()) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*b.columns, *more], [*df_columns, "key", "n", "bands"])

    df_columns, at = df.columns, df.columns.index(text)
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df_columns]
    return by_batch(df, emit, ", ".join([*kinds, "key binary", "n int", "bands array<long>"]), rows=256)


def parities(h: np.ndarray) -> bytes:
    """A bit for each cell: is the number of shingles there odd."""
    return np.packbits(np.bincount((h % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) & 1).tobytes()


def shingle_sets(df: DataFrame, *, text: str, shingle: int) -> DataFrame:
    """(key, shingles, parity) of (key, text): the set in order, and its parities."""

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, shingle)) for t in utf8(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([h.astype("<u8").tobytes() for h in sets], pa.binary()), pa.array(list(map(parities, sets)), pa.binary())], ["key", "shingles", "parity"])

    return by_batch(df.select("key", text), emit, "key binary, shingles binary, parity binary", rows=256)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_bucket(rows: DataFrame, order: list[str], f: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``f`` on whole buckets, some at a time: rows ordered by g and ``order``, and the number of each row's bucket."""
    small_batches(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            kept = b if kept is None else pa.concat_batches([kept, b])
            g = kept.column(0).to_numpy()
            last = int(np.flatnonzero(g != g[-1])[-1]) + 1 if len(g) and g[0] != g[-1] else 0
            if last:
                yield from f(kept.slice(0, last), _numbers(g[:last]))
                kept = kept.slice(last)
        if kept is not None and kept.num_rows:
            yield from f(kept, _numbers(kept.column(0).to_numpy()))

    return rows.repartition(_parts(rows), "g").sortWithinPartitions("g", *order).mapInArrow(run, schema)


def _numbers(g: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(g[1:] != g[:-1])))


def crowds(nodes: DataFrame) -> DataFrame:
    """(g, key, n): the rows of all buckets of two nodes or more."""

    def several(b: pa.RecordBatch, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.bincount(number)[number] > 1)
        if len(at):
            yield b.take(pa.array(at))

    return _by_bucket(nodes.select(F.explode("bands").alias("g"), "key", "n"), [], several, "g long, key binary, n int")


def _pairs(b: pa.RecordBatch, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(1).take(pa.array(x)), b.column(1).take(pa.array(y))], ["a", "b"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def neighbours(crowd: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of neighbours in an order of each bucket's own; the sizes of their sets allow the similarity."""

    def near(b: pa.RecordBatch, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = b.column(2).to_numpy().astype(np.int64)
        x = np.flatnonzero(number[1:] == number[:-1])
        x = x[100 * np.minimum(n[x], n[x + 1]) >= percent * np.maximum(n[x], n[x + 1])]
        if len(x):
            yield _pairs(b, x, x + 1)

    rows = crowd.select("g", "key", "n", F.xxhash64("g", "key").alias("place"))
    return _ordered(_by_bucket(rows, ["place"], near, "a binary, b binary"))


def fingerprint_links(nodes: DataFrame, *, text: str, shingle: int, percent: int, radius: int = 3) -> DataFrame:
    """(a, b): SimHash's links between nodes (key, n, text); the sizes of their sets allow the similarity. Of nodes with one fingerprint each is linked to the next."""
    from pyspark.sql import Window

    prints = cut(fingerprints(nodes.select("key", text), text=text, id_col="key", shingle=shingle).join(nodes.select("key", "n"), "key"), "prints")
    # A row for each part of a fingerprint's nodes and then one for each fingerprint: equal ones, however many, are no one task's.
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    near = Window.partitionBy("fp", "salt").orderBy("n", "key")
    same = salted.select("key", "n", F.lead("key").over(near).alias("b"), F.lead("n").over(near).alias("m"))
    heads = cut(salted.groupBy("fp", "salt").agg(F.min(F.struct("key", "n")).alias("x")), "heads")
    first = cut(heads.groupBy("fp").agg(F.min("x").alias("x")), "reps")
    over = heads.join(first.select("fp", F.col("x").alias("y")), "fp").select(F.col("x.key").alias("key"), F.col("x.n").alias("n"), F.col("y.key").alias("b"), F.col("y.n").alias("m"))
    near = links(first.select("fp"), pigeonhole(64, radius, radius + 2), radius)
    x, y = (first.select(F.col("fp").alias(k), F.col("x.key").alias(f"{k}k"), F.col("x.n").alias(f"{k}n")) for k in "ab")
    far = near.join(x, "a").join(y, "b").select(F.col("ak").alias("key"), F.col("an").alias("n"), F.col("bk").alias("b"), F.col("bn").alias("m"))
    found = same.unionByName(over).unionByName(far).filter(F.col("b").isNotNull() & (F.col("key") != F.col("b")))
    return _ordered(found.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select(F.col("key").alias("a"), "b"))


def across(crowd: DataFrame, size: int, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """(a, b): all pairs of each bucket (``size`` rows in all) that are of different roots; the sizes and parities of their sets allow the similarity."""

    def apart(b: pa.RecordBatch, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = b.column(2).to_numpy().astype(np.int64)
        root = b.column(3).dictionary_encode().indices.to_numpy()
        odd = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(len(n), -1)
        starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        held, size = [], 0
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(number)).tolist(), strict=True):
            if (root[s:e] == root[s]).all():
                continue
            for i in range(s, e - 1):  # by size, so the last that is not too large ends the row
                end = int(np.searchsorted(n[i + 1 : e], 100 * n[i] // percent, "right")) + i + 1
                y = np.flatnonzero(root[i + 1 : end] != root[i]) + i + 1
                y = y[(100 + percent) * np.bitwise_count(odd[y] ^ odd[i]).sum(1, dtype=np.int64) <= (100 - percent) * (n[y] + n[i])]
                if len(y):
                    held.append((np.full(len(y), i), y))
                    size += len(y)
                if size >= CHUNK:
                    yield _pairs(b, *map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield _pairs(b, *map(np.concatenate, zip(*held, strict=True)))

    open_ = cut(crowd.groupBy("g").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("g", "m"), "open", rows=size)
    rows = crowd.join(open_, "g").join(sets.select("key", "parity"), "key").withColumn("tiles", F.ceil(F.col("m") / tile).cast("long"))
    whole = rows.filter("tiles = 1").select("g", "key", "n", "root", "parity")
    t = F.pmod(F.xxhash64("key"), F.col("tiles"))
    dealt = rows.filter("tiles > 1").select("g", "key", "n", "root", "parity", t.alias("t"), F.explode(F.expr("sequence(0L, tiles - 1)")).alias("u"))
    dealt = dealt.select(F.xxhash64("g", F.least("t", "u"), F.greatest("t", "u")).alias("g"), "key", "n", "root", "parity")
    return _ordered(_by_bucket(whole.unionByName(dealt), ["n"], apart, "a binary, b binary"))


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs whose sets have the similarity of ``percent`` or more."""

    def exact(b: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = np.sort(np.concatenate((x, y)), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            good.append(100 * shared >= percent * (len(both) - shared))
        return b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    x, y = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "ab")
    return by_batch(pairs.join(x, "a").join(y, "b").select("a", "b", "a_set", "b_set"), exact, "a binary, b binary")


def near_copies(df: DataFrame, *, text: str = "text", id_col: str = "doc_id", shingle: int = 5, percent: int = 80, tile: int = TILE) -> DataFrame:
    """The columns of ``df`` but the text, with key, n, root and component_id: a row for each row; a component has one root, and its least id."""
    own = cut(sketches(df, text=text, shingle=shingle), "sketches")
    nodes = own.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    crowd = cut(crowds(nodes), "crowds")
    linked = cut(fingerprint_links(own.select("key", "n", text).dropDuplicates(["key"]), text=text, shingle=shingle, percent=percent), "linked")
    met = crowd.select("key").union(linked.select("a")).union(linked.select("b")).distinct()
    sets = own.select("key", text).join(met, "key", "left_semi").dropDuplicates(["key"])
    sets = cut(shingle_sets(sets, text=text, shingle=shingle), "sets")
    first = cut(similar(linked.union(neighbours(crowd, percent)).distinct(), sets, percent), "first")
    roots = cut(connected_components(first, "a", "b"), "roots", rows=2 * first.count())
    rooted = crowd.join(roots, F.col("key") == F.col("node"), "left").select("g", "key", "n", F.coalesce("root", "key").alias("root"))
    size = crowd.count()
    rest = cut(similar(across(cut(rooted, "rooted", rows=size), size, sets, percent, tile), sets, percent), "rest")
    if not rest.isEmpty():
        roots = connected_components(first.union(rest), "a", "b")
    rows = own.drop("bands", text).join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = cut(rows, "rows", rows=own.count())
    return rows.join(rows.groupBy("root").agg(F.min(id_col).alias("component_id")), "root")
