"""Edge cuts and marks: apply deletions, reduce transitive edges, find compressible links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions.dna import flip_dir, oriented
from helixframe.operators import sides
from helixframe.operators.crowded import crowded_keys
from helixframe.operators.implied import CODED, implied
from helixframe.operators.kmers import CODE as KMER_CODE
from helixframe.operators.meeting import earlier
from helixframe.operators.overlap import EDGE, flipped
from helixframe.plans.scratch import cut
from helixframe.plans.ship import arrow

SIDE = ["src", "src_dir"]


def degrees(edges: DataFrame) -> DataFrame:
    """(src, src_dir, deg)."""
    return edges.groupBy("src", "src_dir").agg(F.count("*").alias("deg"))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with fdeg and rdeg."""
    d = edges.groupBy(F.col("src").alias("node_id")).agg(F.count_if(F.col("src_dir") == "f").alias("fdeg"), F.count_if(F.col("src_dir") == "r").alias("rdeg"))
    return nodes.join(d, "node_id", "left").fillna(0, ["fdeg", "rdeg"])


def extensions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with what the neighbour adds beyond the overlap (ext), its coverage and its length; edges that carry these need no nodes."""
    if "ext" in edges.columns:
        return edges.select(*EDGE, "ext", "dst_cov", (F.col("ovl") + F.length("ext")).alias("dst_len"))
    n = nodes.select(F.col("node_id").alias("dst"), "seq", F.col("cov").alias("dst_cov"))
    return edges.join(n, "dst").select(*EDGE, F.substr(oriented("seq", "dst_dir"), F.col("ovl") + 1).alias("ext"), "dst_cov", F.length("seq").alias("dst_len"))


def both_copies(marked: DataFrame) -> DataFrame:
    return marked.select(*EDGE).union(flipped(marked)).distinct()


def edge_removal(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """Edges but for the marked ones; marks without an edge do nothing."""
    return edges.join(marked.select(*EDGE).distinct(), EDGE, "left_anti")


def node_removal(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes but for ``gone`` (node_id), and edges that touch none of these."""
    g = gone.select("node_id").distinct()
    kept = edges.join(g.withColumnRenamed("node_id", "src"), "src", "left_anti").join(g.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.join(g, "node_id", "left_anti"), kept.select(*EDGE)


def whole_sides(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole sides, as far as the sorted batches bring them, and where each side begins."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        if t.num_rows > 1:
            new[1:] = False
            for c in by:
                v = t.column(c).combine_chunks()
                new[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    for b in filter(len, batches):
        t = pa.Table.from_batches([*held, b])
        at = starts(t)
        if at[-1]:
            yield t.slice(0, at[-1]), at[:-1]
        held = t.slice(at[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held), np.zeros(1, np.int64)


#: Edges of a side up to which these are compared pair by pair.
PAIRED = 128
#: Parts to which sides are dealt, one of which a task reduces at once, and edges that a task packs at once.
PARTS, AT_ONCE = 4096, 1 << 19


def _implied_short(t: pa.Table, at: np.ndarray) -> np.ndarray:
    """Is each edge of these whole sides implied? Extensions are numbers; of a side of many edges, or a text that no number holds, they are read as in ``_implied``."""
    ext = t.column("ext").combine_chunks().cast(pa.binary())
    offsets = np.frombuffer(ext.buffers()[1], np.int32)[ext.offset : ext.offset + len(ext) + 1].astype(np.int64)
    raw = np.frombuffer(ext.buffers()[2] or b"", np.uint8)
    size, counts = np.diff(offsets), np.diff(np.append(at, t.num_rows))
    side, ovl = np.repeat(np.arange(len(at)), counts), t.column("ovl").to_numpy()
    code = np.zeros(len(size), np.uint64)
    for j in range(min(int(size.max()), CODED)):
        some = np.flatnonzero(size > j)
        code[some] |= KMER_CODE[raw[offsets[some] + j]] << np.uint64(62 - 2 * j)
    long = (np.repeat(counts, counts) > PAIRED) | np.repeat(np.maximum.reduceat(size, at) > CODED, counts)
    dst = t.column("dst").combine_chunks()
    ahead = pc.equal(t.column("src_dir").combine_chunks(), "f").to_numpy(zero_copy_only=False)

    out = implied(side, code, size, ovl, lambda y, x: earlier(ahead[x], dst.take(pa.array(y)), dst.take(pa.array(x))), skip=long)
    if long.any():
        rows = np.flatnonzero(long)
        texts = ext.take(pa.array(rows)).cast(pa.string()).to_pylist()
        own = list(zip(*(t.column(c).take(pa.array(rows)).to_pylist() for c in SIDE), texts, (-ovl[rows].astype(np.int64)).tolist(), dst.take(pa.array(rows)).to_pylist(), strict=True))
        by = sorted(range(len(rows)), key=lambda i: own[i][:4])
        marks = _implied((*own[i][:2], 0, own[i][2], -own[i][3], own[i][4], None, None) for i in by)
        out[rows[by]] = list(marks)
    return out


#: An edge on its way to its side's part; where ids are numbers, such an edge.
PACKED = pa.schema([("src", pa.string()), ("src_dir", pa.string()), ("dst", pa.string()), ("dst_dir", pa.string()), ("ovl", pa.int32()), ("ext", pa.string())])
NUMBERED = pa.schema([("src", pa.int64()), ("src_dir", pa.string()), ("dst", pa.int64()), ("dst_dir", pa.string()), ("ovl", pa.int32()), ("ext", pa.string())])


def _packed(t: pa.Table) -> pa.RecordBatch:
    """(part, data) of (part, EDGE, ext): the edges that go to one part, as one row."""
    part = t.column("part").to_numpy()
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    last = np.append(first[1:], len(part))
    columns = []
    for name in (*EDGE, "ext"):
        c = t.column(name).combine_chunks().take(pa.array(order))
        if pa.types.is_integer(c.type):
            columns.append((None, c.to_numpy()))
            continue
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        columns.append((np.diff(ends).astype("<u2") if "dir" not in name else None, (ends.tolist(), bytes(c.buffers()[2] or b""))))
    data = []
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        row = [(j - i).to_bytes(4, "little")]
        for sizes, x in columns:
            if sizes is not None:
                row.append(sizes[i:j].tobytes())
            row.append(x[1][x[0][i] : x[0][j]] if isinstance(x, tuple) else x[i:j].tobytes())
        data.append(b"".join(row))
    return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(data, pa.binary())], ["part", "data"])


def _unpacked(data: list[bytes], schema: pa.Schema = PACKED) -> pa.Table:
    """The edges of one part."""
    sizes: dict[str, list[np.ndarray]] = {name: [] for name in schema.names}
    letters: dict[str, list[bytes]] = {name: [] for name in schema.names}
    for x in data:
        n, at = int.from_bytes(x[:4], "little"), 4
        for name, kind in zip(schema.names, schema.types, strict=True):
            if pa.types.is_integer(kind):
                size, total = None, kind.bit_width // 8 * n
            elif "dir" in name:
                size, total = np.ones(n, np.uint16), n
            else:
                size = np.frombuffer(x, "<u2", n, at)
                at, total = at + 2 * n, int(size.sum(dtype=np.int64))
            if size is not None:
                sizes[name].append(size)
            letters[name].append(x[at : at + total])
            at += total
    columns = []
    for name, kind in zip(schema.names, schema.types, strict=True):
        raw = b"".join(letters[name])
        if pa.types.is_integer(kind):
            columns.append(pa.array(np.frombuffer(raw, kind.to_pandas_dtype()), kind))
            continue
        ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes[name]), dtype=np.int64))).astype(np.int32)
        columns.append(pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(raw)))
    return pa.Table.from_arrays(columns, schema=schema)


def _not_implied(edges: DataFrame) -> DataFrame:
    """Edges (EDGE) of ``edges`` with extensions that none of their side implies.

    Edges go to the part of their side, many in a row, and nothing but these rows is
    sorted on the way.
    """
    part = F.pmod(F.xxhash64(*SIDE), F.lit(PARTS)).cast("int").alias("part")
    schema = NUMBERED if dict(edges.dtypes)["src"] == "bigint" else PACKED

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in filter(len, batches):
            held.append(b)
            if sum(x.num_rows for x in held) >= AT_ONCE:
                yield _packed(pa.Table.from_batches(held))
                held = []
        if held:
            yield _packed(pa.Table.from_batches(held))

    def reduce(data: list[bytes]) -> Iterator[pa.RecordBatch]:
        t = _unpacked(data, schema).sort_by([(c, "ascending") for c in SIDE])
        for whole, at in whole_sides(t.combine_chunks().to_batches(), SIDE):
            yield from whole.select(EDGE).filter(pa.array(~_implied_short(whole, at))).combine_chunks().to_batches()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != own and held:
                    yield from reduce(held)
                    held = []
                own = p
                held.append(x)
        if held:
            yield from reduce(held)

    sent = arrow(edges.select(part, *EDGE, "ext"), pack, "part int, data binary")
    return arrow(sent.repartition("part").sortWithinPartitions("part"), scan, edges.select(*EDGE).schema)


def _of_two_copies(edges: DataFrame) -> DataFrame:
    """Edges (each once) whose other copy is there too."""
    mine = (F.col("src") < F.col("dst")) | ((F.col("src") == F.col("dst")) & (F.col("src_dir") <= flip_dir("dst_dir")))
    pair = [F.when(mine, one).otherwise(two).alias(c) for c, one, two in (("src", F.col("src"), F.col("dst")), ("src_dir", F.col("src_dir"), flip_dir("dst_dir")), ("dst", F.col("dst"), F.col("src")), ("dst_dir", F.col("dst_dir"), flip_dir("src_dir")))]
    alone = (F.col("src") == F.col("dst")) & (F.col("src_dir") != F.col("dst_dir"))  # its own other copy
    # Dealt out first: before its exchange an aggregate of texts combines nothing here, as the copies are in different tasks.
    both = edges.select(*pair, "ovl").repartition(*EDGE[:4]).groupBy(*EDGE).agg(F.count("*").alias("n")).filter((F.col("n") == 2) | alone)
    one = F.struct("src", "src_dir", "dst", "dst_dir")
    two = F.struct(F.col("dst").alias("src"), flip_dir("dst_dir").alias("src_dir"), F.col("src").alias("dst"), flip_dir("src_dir").alias("dst_dir"))
    return both.select(F.explode(F.when(alone, F.array(one)).otherwise(F.array(one, two))).alias("e"), "ovl").select("e.*", "ovl")


#: Edges of a side from which its texts are dealt to more than one task, and texts drawn for each of these.
SIDE_ROWS, DRAWS = 50_000, 16


def _dealt(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(EDGE, ext, part, lo, hi): extensions; sides of very many edges are cut between their texts.

    A text that is a prefix of the first one of a later part is told to that part
    as well, by a row without a neighbour. Only a text's edges of the largest
    overlap can count there, and of these the least and greatest neighbours (lo,
    hi); a text of n letters has n prefixes, so a part is told few rows however
    large the side is.
    """
    key = F.xxhash64(*SIDE)
    many = crowded_keys(edges, key, {"n": F.lit(1)}, SIDE_ROWS, edges.count())
    none = [F.lit(None).cast("string").alias(c) for c in ("lo", "hi")]
    if many is None:
        return extensions(edges, nodes).select(*EDGE, "ext", F.lit(0).alias("part"), *none)
    x = cut(extensions(edges, nodes).select(*EDGE, "ext", key.alias("key")), "extensions")
    large, rest = x.join(many.select("key"), "key"), x.join(many.select("key"), "key", "left_anti")
    odds = F.pmod(F.xxhash64("dst", "dst_dir", "ovl", "ext"), F.lit(SIDE_ROWS // DRAWS)) == 0
    drawn = large.filter(odds).groupBy(*SIDE).agg(F.array_sort(F.collect_list("ext")).alias("t"))  # DRAWS texts for SIDE_ROWS edges
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size("t") / DRAWS).cast("int"))), lambda i: F.get("t", i * DRAWS - 1))
    cuts = cut(drawn.select(*SIDE, F.array_sort(F.array_distinct(F.filter(every, lambda t: t.isNotNull()))).alias("cuts")), "cuts")
    large = large.join(cuts, SIDE, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<string>")))
    large = large.withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("ext"))))
    top = large.groupBy(*SIDE, "ext", "part", "cuts").agg(F.max("ovl").alias("ovl"))
    ends = large.groupBy(*SIDE, "ext", "ovl").agg(F.min("dst").alias("lo"), F.max("dst").alias("hi"))
    later = F.filter(F.sequence(F.lit(0), F.size("cuts")), lambda p: (p > F.col("part")) & F.startswith(F.get("cuts", p - 1), F.col("ext")))
    told = top.join(ends, [*SIDE, "ext", "ovl"]).withColumn("part", F.explode(later))
    told = told.select("src", "src_dir", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("dst_dir"), "ovl", "ext", "part", "lo", "hi")
    return rest.select(*EDGE, "ext", F.lit(0).alias("part"), *none).unionByName(large.select(*EDGE, "ext", "part", *none)).unionByName(told)


def _implied(rows: Iterable[tuple]) -> Iterator[bool]:
    """For each (side, part, text, overlap, neighbour, least, greatest) in the order of side, part, text and falling overlap: is it implied by a row before it?

    The texts that are prefixes of the present one are a stack. An entry has the
    largest overlap down to it, the shortest text that has this, and the least
    and greatest neighbours of that.
    """
    side, stack = None, []
    for src, src_dir, part, text, ovl, dst, lo, hi in rows:
        if lo is None:
            lo = hi = dst
        if (src, src_dir, part) != side:
            side, stack = (src, src_dir, part), []
        while stack and not text.startswith(stack[-1][0]):
            stack.pop()
        n = len(text)
        if stack:
            _, most, short, low, high = stack[-1]
            implied = most > ovl
            if most == ovl and short < n and dst is not None:
                ahead, own = (most + short + 1) // 2, (ovl + n + 1) // 2  # packed lengths
                implied = ahead < own or ahead == own and (low < dst if src_dir == "f" else high > dst)
            yield implied
            if len(stack[-1][0]) == n:
                if most == ovl and short == n:
                    stack[-1] = (text, most, short, min(low, lo), max(high, hi))
                continue
            if ovl <= most:
                stack.append((text, most, short, low, high))
                continue
        else:
            yield False
        stack.append((text, ovl, n, lo, hi))


def _scanned(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (EDGE) with ``implied``."""
    dealt = _dealt(edges, nodes).repartition(*SIDE, "part").sortWithinPartitions(*SIDE, "part", "ext", F.desc("ovl"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows() -> Iterator[tuple]:
            for b in filter(len, batches):
                held.append(b)
                yield from zip(*(b.column(c).to_pylist() for c in ("src", "src_dir", "part", "ext", "ovl", "dst", "lo", "hi")), strict=True)

        found = _implied(rows())
        for first in found:
            b = held.pop()
            marks = pa.array([first, *islice(found, b.num_rows - 1)], pa.bool_())
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in EDGE), marks], [*EDGE, "implied"])
            yield out.filter(out.column("dst").is_valid())

    schema = T.StructType([*edges.select(*EDGE).schema.fields, T.StructField("implied", T.BooleanType())])
    return arrow(dealt, scan, schema)


def transitive_marks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges implied by another one of their side whose extension is a prefix of theirs.

    The other one comes earlier: a longer overlap, or an equal one of a shorter
    packed neighbour, then by id (upwards on the f side, downwards on the r
    side); equal overlap and length imply nothing. A side's extensions are
    sorted as texts and read once, with the prefixes of the present one as a
    stack: a row for each edge, however many lengths its side has, and memory
    for one text's prefixes. Sides of more than ``SIDE_ROWS`` edges are read in
    parts by several tasks.
    """
    return _scanned(edges, nodes).filter("implied").select(*EDGE)


def transitive_reduction(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which neither copy is implied.

    Edges that carry their extensions are in both copies; of these, no implied one is
    written or exchanged: an edge stays where both copies are left.
    """
    if "ext" in edges.columns:
        return _of_two_copies(_not_implied(edges))
    found = cut(_scanned(edges, nodes), "scanned")
    return found.filter("NOT implied").select(*EDGE).join(flipped(found.filter("implied")), EDGE, "left_anti")


def compressible(edges: DataFrame) -> DataFrame:
    """Links that are the only one on both facing sides and lead to another node."""
    if "deg" in edges.columns and dict(edges.dtypes)["src"] == "bigint":
        return sides.told(edges).filter("link").drop("link")
    d = degrees(edges).filter(F.col("deg") == 1).select("src", "src_dir")
    facing = d.select(F.col("src").alias("dst"), flip_dir("src_dir").alias("dst_dir"))
    return edges.filter(F.col("src") != F.col("dst")).join(d, ["src", "src_dir"], "left_semi").join(facing, ["dst", "dst_dir"], "left_semi").select(*EDGE)


def compress_neighborhood(edges: DataFrame) -> DataFrame:
    """(node_id, is_compressible): nodes with a compressible side, and the neighbours of these."""
    own = compressible(edges).select(F.col("src").alias("node_id")).distinct()
    near = edges.join(own.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("dst").alias("node_id"))
    return own.withColumn("c", F.lit(1)).union(near.withColumn("c", F.lit(0))).groupBy("node_id").agg((F.max("c") == 1).alias("is_compressible"))
