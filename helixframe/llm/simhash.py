"""SimHash near-duplicates: fingerprints, exact comparison in tiles, components.

A fingerprint's bit is the majority of that bit over the hashes of a text's
word shingles. Texts whose fingerprints differ in at most ``radius`` bits are
linked. Only fingerprints that agree on the bits of one of several tables meet
(for the exact tables of ``pigeonhole`` none that should be linked are missed);
those that meet are compared by exclusive-or and bit counts in numpy, tile by
tile, ordered by their own bit counts so that tile pairs whose counts lie
further apart than the radius are skipped.

Every row takes part. Null and empty texts have fingerprint zero, linked like
any other. Equal fingerprints are one node, however many rows have them, so
copies never multiply. Rows with a null id get their component's id too. Texts
of any length are read whole. Columns other than id and text are left out, so
their names clash with none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import by_batch, table, utf8
from helixframe.llm.components import connected_components
from helixframe.plans.scratch import cut

#: Rows of a tile; a table's bucket of more is dealt out as pairs of tiles.
TILE = 8192
#: Side of the squares in which rows of a tile are compared.
SQUARE = 512


def pigeonhole(bits: int, radius: int, blocks: int) -> list[list[int]]:
    """Tables of bit places: two fingerprints within ``radius`` bits agree on one table at least, as long as blocks > radius."""
    cuts = np.linspace(0, bits, blocks + 1).astype(int)
    parts = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen, []) for chosen in combinations(parts, blocks - radius)]


def bands(bits: int, width: int) -> list[list[int]]:
    """Tables of ``width`` neighbouring bits: each is one chance for two near fingerprints to meet."""
    return [list(range(i, i + width)) for i in range(0, bits - width + 1, width)]


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, repeats included; of the whole if there are fewer words."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if n <= size:
        return np.array([h(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([h(joined[i:j], 42) for i, j in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray, words: int) -> bytes:
    """The fingerprint, big-endian: a bit is 1 if it is set in over half of the hashes. Words after the first mix each hash anew."""
    if not len(h):
        return bytes(8 * words)
    out = []
    for w in range(words):
        x = h
        if w:
            x = (h + np.uint64((0x9E3779B97F4A7C15 * w) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(32)
        total = np.zeros(64, np.int64)
        for i in range(0, len(x), 16384):
            total += np.unpackbits(x[i : i + 16384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * total > len(h)).tobytes())
    return b"".join(out)


def fingerprints(df: DataFrame, *, text: str = "text", id_col: str = "doc_id", shingle: int = 3, words: int = 1) -> DataFrame:
    """(id, fp): a row for each row; fp has 8 x ``words`` bytes."""

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [majority(shingle_hashes(t, shingle), words) for t in utf8(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], [id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return by_batch(df.select(id_col, text), emit, f"`{id_col}` {kind}, fp binary")


def _table_rows(reps: DataFrame, tables: list[list[int]], words: int) -> DataFrame:
    """(g, pop, fp): each fingerprint once for each table, under the table's number and its bits there."""

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        raw = b.column(0).to_pylist()
        bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(n, -1), axis=1)
        pop = bits.sum(1, dtype=np.int32)
        keys = [bits[:, t].astype(np.int64) @ (np.int64(1) << np.arange(len(t), dtype=np.int64)) + (np.int64(i) << 50) for i, t in enumerate(tables)]
        fp = pa.array(raw * len(tables), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(pop, len(tables))), fp], ["g", "pop", "fp"])

    return by_batch(reps.select("fp"), emit, "g long, pop int, fp binary")


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i[k] and j[k]; a set's root is its least member."""
    while len(i):
        for x in (i, j):
            while (parent[x] != x).any():
                x[:] = parent[x]
        apart = i != j
        i, j = np.minimum(i, j)[apart], np.maximum(i, j)[apart]
        np.minimum.at(parent, j, i)


def link_runs(g: np.ndarray, pop: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """parent[i]: within each run of equal ``g`` the least row that i is linked to, by way of others or not. Rows are ordered by (g, pop)."""
    n = len(g)
    parent = np.arange(n)
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    sizes = np.diff(np.append(starts, n))
    small = np.repeat(sizes <= 64, sizes)
    alive, d = np.flatnonzero(small), 0
    while len(alive):
        d += 1
        alive = alive[alive + d < n]
        alive = alive[(g[alive + d] == g[alive]) & (pop[alive + d] - pop[alive] <= radius)]
        near = np.bitwise_count(fp[alive] ^ fp[alive + d]).sum(1) <= radius
        _unite(parent, alive[near].copy(), alive[near] + d)
    for s, m in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        for i in range(s, s + m, SQUARE):
            a = slice(i, min(i + SQUARE, s + m))
            for j in range(i, s + m, SQUARE):
                b = slice(j, min(j + SQUARE, s + m))
                if pop[j] - pop[a.stop - 1] > radius:
                    break
                apart = np.bitwise_count(fp[a, None, 0] ^ fp[None, b, 0]).astype(np.int16)
                for w in range(1, fp.shape[1]):
                    apart += np.bitwise_count(fp[a, None, w] ^ fp[None, b, w])
                x, y = np.nonzero(apart <= radius)
                x, y = x + i, y + j
                ahead = x < y
                _unite(parent, x[ahead], y[ahead])
    for _ in range(64):
        parent = parent[parent]
        if (parent[parent] == parent).all():
            break
    return parent


def links(reps: DataFrame, tables: list[list[int]], radius: int, *, words: int = 1, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints that give the components; one at most for each row of a bucket, not one for each pair."""
    rows = _table_rows(reps, tables, words)
    large = rows.groupBy("g").agg(F.count("*").alias("m")).filter(F.col("m") > tile).select("g")
    large = cut(large, "large")
    if large.isEmpty():
        dealt = rows
    else:
        dealt = rows.join(large, "g", "left_anti").unionByName(_tile_pairs(rows.join(large, "g"), radius, tile))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty((0, words), np.uint64)]

        def found(g: np.ndarray, pop: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            parent = link_runs(g, pop, fp, radius)
            i = np.flatnonzero(parent != np.arange(len(g)))
            raw = fp.astype(">u8")
            a, b = ([raw[k].tobytes() for k in x.tolist()] for x in (i, parent[i]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for b in batches:
            fp = np.frombuffer(b"".join(b.column(2).to_pylist()), ">u8").reshape(-1, words).astype(np.uint64)
            kept = [np.concatenate(x) for x in zip(kept, (b.column(0).to_numpy(), b.column(1).to_numpy(), fp), strict=True)]
            if not len(kept[0]):
                continue
            last = int(np.searchsorted(kept[0], kept[0][-1]))
            if last:
                yield found(*(x[:last] for x in kept))
                kept = [x[last:] for x in kept]
        if len(kept[0]) > 1:
            yield found(*kept)

    return dealt.repartition(_parts(reps.sparkSession), "g").sortWithinPartitions("g", "pop").mapInArrow(compare, "a binary, b binary").distinct()


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _tile_pairs(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """Rows of large buckets, dealt to pairs of tiles; a tile holds rows of neighbouring bit counts.

    g is then a hash of bucket and tile pair. Should two pairs meet under one
    hash, they are compared in vain; a link never rests on g.
    """
    from pyspark.sql import Window

    cells = rows.groupBy("g", "pop").agg(F.count("*").alias("c"))
    cells = cells.withColumn("before", F.sum("c").over(Window.partitionBy("g").orderBy("pop")) - F.col("c"))
    cells = cut(cells, "cells")
    place = ((F.col("before") + F.pmod(F.xxhash64("fp"), F.col("c"))) / tile).cast("long")
    rows = rows.join(cells, ["g", "pop"]).select("g", "pop", "fp", place.alias("t"))
    span = F.explode(F.sequence((F.col("before") / tile).cast("long"), ((F.col("before") + F.col("c") - 1) / tile).cast("long")))
    tiles = cells.select("g", "pop", span.alias("t")).groupBy("g", "t").agg(F.min("pop").alias("lo"), F.max("pop").alias("hi"))
    x = tiles.select("g", F.col("t").alias("t1"), "hi")
    y = tiles.select("g", F.col("t").alias("t2"), "lo")
    pairs = x.join(y, "g").filter(f"t1 <= t2 AND lo - hi <= {radius}")
    pairs = pairs.select("g", F.explode(F.array_distinct(F.array("t1", "t2"))).alias("t"), F.xxhash64("g", "t1", "t2").alias("pair"))
    return rows.join(pairs, ["g", "t"]).select(F.col("pair").alias("g"), "pop", "fp")


def near_duplicates(df: DataFrame, *, text: str = "text", id_col: str = "doc_id", shingle: int = 3, radius: int = 3, words: int = 1, tables: list[list[int]] | None = None, tile: int = TILE) -> DataFrame:
    """(id, fp, component_id): a row for each row; a component has its least id. ``tables``: those of ``pigeonhole`` unless given."""
    tables = tables or pigeonhole(64 * words, radius, radius + 2)
    own = cut(fingerprints(df, text=text, id_col=id_col, shingle=shingle, words=words), "prints")
    reps = cut(own.groupBy("fp").agg(F.min(id_col).alias("first")), "reps", rows=own.count())
    found = connected_components(links(reps, tables, radius, words=words, tile=tile), "a", "b")
    known = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(known.join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at 3 bits or fewer, exact tables."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
