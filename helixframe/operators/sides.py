"""Edges between numbered short reads, as numbers: reduced, and counted by side.

A side is twice its node's number, and one more on the r side; a text is one or two
words. Edges go from the task that finds them to the part of their side, and from
there to those of both sides that they join, as rows of many edges each: no edge is a
row before it is known to stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.implied import CODED, implied
from helixframe.plans.ship import arrow

#: Parts to which sides are dealt, edges that a task packs at once, edges of a side up to which these are compared pair by pair, and edges before it that one is held against first.
PARTS, AT_ONCE, PAIRED, NEAR = 4096, 1 << 19, 128, 32
#: An edge as numbers: its sides, the overlap, and what the neighbour adds, of ``size`` letters in two words.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_ACGT = np.frombuffer(b"ACGT", np.uint8)
_DIRS = pa.array(["f", "r"])
FOUND, JOINED = ("<i8", "<i8", "u1", "u1"), ("<i8", "<i8", "u1", "?")


def _part(side: np.ndarray) -> np.ndarray:
    return (side.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % PARTS


def _dealt(side: np.ndarray, columns: list[np.ndarray], head: bytes) -> pa.RecordBatch:
    """(part, data): the rows of one part as one, each column behind the other."""
    part = _part(side)
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    last = np.append(first[1:], len(part))
    data = [b"".join(((j - i).to_bytes(4, "little"), head, *(c[i:j].tobytes() for c in columns))) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(data, pa.binary())], ["part", "data"])


def pack(e: Found) -> pa.RecordBatch:
    """(part, data) of edges, by their side. Of words only what the longest text needs is kept."""
    src, dst, ovl, size, high, low = e
    most = int(size.max()) if len(size) else 0
    words = [(high >> np.uint64(32)).astype("<u4")] if most <= 16 else [high.astype("<u8")] if most <= 32 else [high.astype("<u8"), low.astype("<u8")]
    return _dealt(src, [*(c.astype(kind) for c, kind in zip((src, dst, ovl, size), FOUND, strict=True)), *words], bytes((4 if most <= 16 else 8 * len(words),)))


def unpack(data: list[bytes]) -> Found:
    found: list[list[np.ndarray]] = [[] for _ in range(6)]
    for x in data:
        n, width, at = int.from_bytes(x[:4], "little"), x[4], 5
        for c, kind in zip(found, FOUND, strict=False):
            c.append(np.frombuffer(x, kind, n, at))
            at += c[-1].nbytes
        if width == 4:
            found[4].append(np.frombuffer(x, "<u4", n, at).astype(np.uint64) << np.uint64(32))
        else:
            found[4].append(np.frombuffer(x, "<u8", n, at))
        found[5].append(np.frombuffer(x, "<u8", n, at + 8 * n) if width == 16 else np.zeros(n, np.uint64))
    src, dst, ovl, size, high, low = (np.concatenate(c) for c in found)
    return src, dst, ovl.astype(np.int64), size.astype(np.int64), high, low


def packing(batches: Iterable[Found]) -> Iterator[pa.RecordBatch]:
    """Edges packed ``AT_ONCE`` or so at a time."""
    held: list[Found] = []
    for e in batches:
        held.append(e)
        if sum(len(x[0]) for x in held) >= AT_ONCE:
            yield pack(tuple(np.concatenate(c) for c in zip(*held, strict=True)))
            held = []
    if sum(len(x[0]) for x in held):
        yield pack(tuple(np.concatenate(c) for c in zip(*held, strict=True)))


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[Found]:
    """The edges of (src, src_dir, dst, dst_dir, ovl, ext) as numbers."""
    code = np.zeros(256, np.uint64)
    code[list(b"ACGT")] = range(4)
    for b in filter(len, batches):
        text = b.column(5).cast(pa.binary())
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw, size = np.frombuffer(text.buffers()[2] or b"", np.uint8), np.diff(ends)
        words = np.zeros((2, len(size)), np.uint64)
        for j in range(int(size.max())):
            some = np.flatnonzero(size > j)
            words[j // 32, some] |= code[raw[ends[some] + j]] << np.uint64(62 - 2 * (j % 32))
        sides = [2 * b.column(i).to_numpy(zero_copy_only=False) + (np.asarray(b.column(i + 1).to_numpy(zero_copy_only=False)) == "r") for i in (0, 2)]
        yield *sides, b.column(4).to_numpy(zero_copy_only=False).astype(np.int64), size, words[0], words[1]


def packed(edges: DataFrame) -> DataFrame:
    """(part, data) of edges (EDGE, ext)."""
    return arrow(edges.select("src", "src_dir", "dst", "dst_dir", "ovl", "ext"), lambda batches: packing(_words(batches)), "part int, data binary")


def rows(e: Found) -> pa.RecordBatch:
    """(src, src_dir, dst, dst_dir, ovl)."""
    own = [x for side in e[:2] for x in (pa.array(side >> 1, pa.int64()), _DIRS.take(pa.array((side & 1).astype(np.int8))))]
    return pa.RecordBatch.from_arrays([*own, pa.array(e[2], pa.int32())], ["src", "src_dir", "dst", "dst_dir", "ovl"])


def texts(high: np.ndarray, low: np.ndarray, size: np.ndarray) -> list[str]:
    out = []
    for h, w, n in zip(high.tolist(), low.tolist(), size.tolist(), strict=True):
        x = h << 64 | w
        out.append("".join("ACGT"[x >> (126 - 2 * j) & 3] for j in range(n)))
    return out


def not_implied(e: Found) -> np.ndarray:
    """The numbers of the edges, all those of some sides, that none of their side implies.

    What implies an edge that implies a third one implies this one too, so those that
    are found by near texts are left out at once, and mostly few are left of a side of
    very many; the rest of it is read as in ``graph._implied``.
    """
    from helixframe.operators.graph import _implied

    src, dst, ovl, size, high, low = e
    left = np.arange(len(src))

    def by(own: np.ndarray, skip: np.ndarray, most: int | None) -> np.ndarray:
        to, ahead = dst[own], src[own] & 1 == 0
        return implied(src[own], high[own], size[own], ovl[own], lambda y, x: np.where(ahead[x], to[y] < to[x], to[y] > to[x]), skip, most)

    left = left[~by(left, size > CODED, NEAR)]
    sides, own, counts = np.unique(src[left], return_inverse=True, return_counts=True)
    longest = np.zeros(len(sides), np.int64)
    np.maximum.at(longest, own, size[left])
    long = ((counts > PAIRED) | (longest > CODED))[own]
    gone = by(left, long, None)
    some = left[long]
    if len(some):
        own = list(zip(src[some].tolist(), texts(high[some], low[some], size[some]), (-ovl[some]).tolist(), dst[some].tolist(), strict=True))
        order = sorted(range(len(own)), key=lambda i: own[i][:3])
        marks = _implied((own[i][0] >> 1, "fr"[own[i][0] & 1], 0, own[i][1], -own[i][2], own[i][3] >> 1, None, None) for i in order)
        gone[np.flatnonzero(long)[order]] = list(marks)
    return left[~gone]


def _by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The rows of one part after another."""
    part, held = None, []
    for b in batches:
        for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if p != part and held:
                yield held
                held = []
            part = p
            held.append(x)
    if held:
        yield held


def _claims(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, data): edges that their side leaves, told to it and, as the other copy, to the side that they lead to."""
    held: list[tuple[np.ndarray, ...]] = []

    def given() -> pa.RecordBatch:
        src, dst, ovl = (np.concatenate(c) for c in zip(*held, strict=True))
        told = np.concatenate((src, dst ^ 1)), np.concatenate((dst, src ^ 1)), np.concatenate((ovl, ovl)), np.arange(2 * len(src)) < len(src)
        return _dealt(told[0], [c.astype(kind) for c, kind in zip(told, JOINED, strict=True)], b"")

    for data in _by_part(batches):
        e = unpack(data)
        kept = not_implied(e)
        held.append(tuple(c[kept] for c in e[:3]))
        if sum(len(x[0]) for x in held) >= AT_ONCE:
            yield given()
            held = []
    if sum(len(x[0]) for x in held):
        yield given()


def _agreed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(EDGE, deg): edges that both sides leave, and how many of them the side has."""
    for data in _by_part(batches):
        found: list[list[np.ndarray]] = [[] for _ in JOINED]
        for x in data:
            n, at = int.from_bytes(x[:4], "little"), 4
            for c, kind in zip(found, JOINED, strict=True):
                c.append(np.frombuffer(x, kind, n, at))
                at += c[-1].nbytes
        src, dst, ovl, own = (np.concatenate(c) for c in found)
        order = np.lexsort((own, ovl, dst, src))
        src, dst, ovl, own = src[order], dst[order], ovl[order], own[order]
        # Of an edge those told by the other side come first, then its own.
        met = np.flatnonzero((src[1:] == src[:-1]) & (dst[1:] == dst[:-1]) & (ovl[1:] == ovl[:-1]) & own[1:] & ~own[:-1])
        src, dst, ovl = src[met], dst[met], ovl[met]
        first = np.flatnonzero(np.append(True, src[1:] != src[:-1])) if len(src) else np.empty(0, np.int64)
        times = np.diff(np.append(first, len(src)))
        b = rows((src, dst, ovl, *[ovl] * 3))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.repeat(times, times), pa.int64())], [*b.schema.names, "deg"])


def reduced(found: DataFrame) -> DataFrame:
    """(EDGE, deg) of (part, data): edges that no other one of their side implies, in either copy."""
    told = arrow(found.repartition("part").sortWithinPartitions("part"), _claims, "part int, data binary")
    return arrow(told.repartition("part").sortWithinPartitions("part"), _agreed, "src long, src_dir string, dst long, dst_dir string, ovl int, deg long")


def told(edges: DataFrame) -> DataFrame:
    """(EDGE, link) of (EDGE, deg): the edges that are alone on their side, and whether they are on the other one as well and lead to another node."""
    v, w = (2 * F.col(c) + (F.col(f"{c}_dir") == "r").cast("long") for c in ("src", "dst"))
    one = edges.filter(F.col("deg") == 1).select(v.alias("v"), w.alias("w"), "ovl")
    turned = {c: F.col(c).bitwiseXOR(F.lit(1)) for c in "vw"}
    mine = F.col("v") <= turned["w"]
    one = one.select(F.when(mine, F.col("v")).otherwise(turned["w"]).alias("v"), F.when(mine, F.col("w")).otherwise(turned["v"]).alias("w"), "ovl", mine.alias("mine"))
    # Dealt out first, as the copies are in different tasks.
    both = one.repartition("v", "w").groupBy("v", "w", "ovl").agg(F.count_if("mine").alias("a"), F.count_if(~F.col("mine")).alias("b"))
    # An edge that is its own other copy comes once.
    own, other = F.struct("v", "w"), F.struct(turned["w"].alias("v"), turned["v"].alias("w"))
    each = F.when((F.col("a") > 0) & (F.col("b") > 0), F.array(own, other)).when(F.col("a") > 0, F.array(own)).otherwise(F.array(other))
    both = both.select(F.explode(each).alias("e"), "ovl", ((F.col("a") > 0) & (F.col("b") > 0) & (F.shiftright("v", 1) != F.shiftright("w", 1))).alias("link"))

    def side(c: str) -> tuple:
        return F.shiftright(f"e.{c}", 1), F.when(F.col(f"e.{c}").bitwiseAND(F.lit(1)) == 1, "r").otherwise("f")

    (src, src_dir), (dst, dst_dir) = side("v"), side("w")
    return both.select(src.alias("src"), src_dir.alias("src_dir"), dst.alias("dst"), dst_dir.alias("dst_dir"), "ovl", "link")
