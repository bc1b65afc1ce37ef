"""Chains of compressible links become contigs, by pointer jumping.

Every node has two oriented vertices, (id, f) and (id, r); a compressible link
leads from one to the next, so chains are disjoint paths and rings. Ranges of
neighbouring ids are followed first, each in a task as far as its links lead, so that
a piece of a path is one vertex; where ids tell nothing of the place, pieces are as
short as links. Each piece's first vertex then doubles its jump towards the head of its
path in every round: as many rounds as the logarithm of the pieces of the longest
chain. A chain occurs once for each
strand; the copy is taken in which the end of the least id reads forward, and
that id names the contig. A ring is opened before its least id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.dna import flip_dir, oriented
from helixframe.operators import sides
from helixframe.operators.graph import compressible
from helixframe.operators.overlap import EDGE
from helixframe.plans.scratch import counted, cut
from helixframe.plans.ship import arrow


#: Links of neighbouring ids that a task follows at once.
AT_ONCE = 1 << 20
_CUT = ["rid", "rdir", "pos", "ovl", "least", "root", "tail"]


def _followed(step: np.ndarray, lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that lead to another one each (``step``; to none: -1) the last one on the way, how many steps it is away, and the least ``lowest`` on the way. A row on a ring never comes to an end; it stays at one that leads on."""
    at = np.where(step >= 0, step, np.arange(len(step)))
    far, low = (step >= 0).astype(np.int64), np.minimum(lowest, lowest[at])
    for _ in range(max(1, len(step)).bit_length() + 1):
        if (step[at] < 0).all():
            break
        far, low, at = far + far[at], np.minimum(low, low[at]), at[at]
    return at, far, low


def _followed_here(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dir, rid, rdir, pos, ovl, least, root, tail, pid, pdir) of (id, dir, pid, pdir, ovl): each vertex with the first one of its piece of a path, which is as far as the links at hand at once lead; the least id of the piece for that one (root), and whether no link at hand leads on from it (tail)."""

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = pa.concat_arrays([b.column("id"), b.column("pid")])
        names = ids.dictionary_encode()
        order = np.empty(len(names.dictionary), np.int64)  # numbers that are ordered as ids are
        order[pc.array_sort_indices(names.dictionary).to_numpy()] = np.arange(len(order))
        own = 2 * order[names.indices.to_numpy()] + np.concatenate([pc.equal(b.column(c), "r").to_numpy(zero_copy_only=False) for c in ("dir", "pdir")])
        n = b.num_rows
        row = np.full(2 * len(order), -1, np.int64)
        row[own[:n]] = np.arange(n)
        step = row[own[n:]]
        at, far, _ = _followed(step, np.arange(n))
        if (round_ := step[at] >= 0).any():
            # A ring at hand is a piece of its own, that begins at its first row.
            _, _, low = _followed(step, np.arange(n))
            step = np.where(round_ & (low == np.arange(n)), -1, step)
            at, far, _ = _followed(step, np.arange(n))
        least = np.full(n, 2 * len(order))
        np.minimum.at(least, at, own[:n] // 2)
        root = step < 0
        tail = np.ones(n, bool)
        tail[step[~root]] = False
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        low = names.dictionary.take(pa.array(np.where(root, back[np.minimum(least, len(order) - 1)], 0), mask=~root))
        made = [b.column("id").take(pa.array(at)), b.column("dir").take(pa.array(at)), pa.array(far), b.column("ovl"), low, pa.array(root), pa.array(tail)]
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("dir"), *made, b.column("pid"), b.column("pdir")], ["id", "dir", *_CUT, "pid", "pdir"])

    held: list[pa.RecordBatch] = []
    for b in filter(len, batches):
        held.append(b)
        if sum(x.num_rows for x in held) >= AT_ONCE:
            yield one(held)
            held = []
    if held:
        yield one(held)


def _pieces(pred: DataFrame) -> DataFrame:
    """``pred`` followed as far as ranges of neighbouring ids lead, written."""
    kind = dict(pred.dtypes)["id"]
    columns = f"id {kind}, dir string, rid {kind}, rdir string, pos long, ovl int, least {kind}, root boolean, tail boolean, pid {kind}, pdir string"
    x = pred.select("id", "dir", "pid", "pdir", F.col("ovl").cast("int").alias("ovl"))
    return cut(arrow(x.repartitionByRange("id").sortWithinPartitions("id"), _followed_here, columns), "pieces")


def _jump(pieces: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame, int]:
    """(id, dir, hid, hdir, pos) of the roots of pieces on paths, (id, dir, least) of those on rings, and how many these are.

    A round doubles how far a root's jump leads. The least id on the way is
    carried; a ring's roots never come to a head, and after as many doublings as
    the logarithm of its pieces each knows the ring's least id.
    """
    # A vertex that another piece begins behind is the last one of its own, or the head of its path.
    tails = pieces.filter("tail").select(F.col("id").alias("pid"), F.col("dir").alias("pdir"), "rid", "rdir", F.col("pos").alias("far"))
    state = pieces.filter("root").select("id", "dir", "pid", "pdir", "least").join(tails, ["pid", "pdir"], "left")
    state = state.select("id", "dir", F.coalesce("rid", "pid").alias("hid"), F.coalesce("rdir", "pdir").alias("hdir"), (1 + F.coalesce("far", F.lit(0))).cast("long").alias("pos"), "least", F.col("rid").isNull().alias("done"))
    state, seen = counted(state, "jump", left=F.count_if(~F.col("done")))
    # What is done stays in the table where it got so; a round writes the roots that weren't, fewer every time.
    done, active, left = [state.filter("done")], state.filter("NOT done"), seen["left"]
    for _ in range(max_rounds):
        if left == 0:
            break
        to = reduce(DataFrame.union, done, active)
        to = to.select(F.col("id").alias("hid"), F.col("dir").alias("hdir"), F.col("hid").alias("hid2"), F.col("hdir").alias("hdir2"), F.col("pos").alias("pos2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
        moved = active.join(to, ["hid", "hdir"])
        moved = moved.select("id", "dir", F.col("hid2").alias("hid"), F.col("hdir2").alias("hdir"), (F.col("pos") + F.col("pos2")).alias("pos"), F.least("least", "least2").alias("least"), F.col("done2").alias("done"), (F.col("least2") < F.col("least")).alias("lower"))
        moved, seen = counted(moved, "jump", rows=left, left=F.count_if(~F.col("done")), lower=F.count_if(~F.col("done") & F.col("lower")))
        moved, before, left = moved.drop("lower"), left, seen["left"]
        done, active = [*done, moved.filter("done")], moved.filter("NOT done")
        # A path's roots come to its head one doubling after another; where none did, the rest is on rings, which know their least id once it falls no more.
        if left == before and seen["lower"] == 0:
            break
    return reduce(DataFrame.union, done).select("id", "dir", "hid", "hdir", "pos"), active.select("id", "dir", "least"), left


def chain_places(edges: DataFrame, *, max_rounds: int = 64) -> DataFrame:
    """(id, dir, hid, hdir, pos, ovl): each vertex on a chain, its chain's head, its place, and its overlap with the vertex before."""
    return _places(cut(compressible(edges), "links"), max_rounds)[0]


def _places(link: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """The places, and the links (EDGE) at which rings were opened, if there are rings."""
    pred = link.select(F.col("dst").alias("id"), F.col("dst_dir").alias("dir"), F.col("src").alias("pid"), F.col("src_dir").alias("pdir"), "ovl")
    pieces = _pieces(pred)
    roots, rings, on_rings = _jump(pieces, max_rounds)
    own = [F.col("id").alias("rid"), F.col("dir").alias("rdir")]
    paths = _placed(pieces, roots.select(*own, "hid", "hdir", F.col("pos").alias("far")))
    shut = None
    if on_rings:
        p = pieces.join(rings.select(*own, F.col("least").alias("lowest")), ["rid", "rdir"])
        # The link into (least, f) goes, and on the other strand the one out of (least, r).
        open_ = ~(((F.col("id") == F.col("lowest")) & (F.col("dir") == "f")) | ((F.col("pid") == F.col("lowest")) & (F.col("pdir") == "r")))
        opened = _pieces(p.filter(open_))
        shut = p.filter(~open_).select(F.col("pid").alias("src"), F.col("pdir").alias("src_dir"), F.col("id").alias("dst"), F.col("dir").alias("dst_dir"), "ovl")
        more, *_ = _jump(opened, max_rounds)
        paths = paths.unionByName(_placed(opened, more.select(*own, "hid", "hdir", F.col("pos").alias("far"))))
    return paths, shut


def _placed(pieces: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, dir, hid, hdir, pos, ovl) of the vertices of pieces whose roots (rid, rdir, hid, hdir, far) are placed, and of the heads."""
    own = pieces.select("id", "dir", "rid", "rdir", "pos", "ovl").join(roots, ["rid", "rdir"]).select("id", "dir", "hid", "hdir", (F.col("pos") + F.col("far")).alias("pos"), "ovl")
    heads = roots.select("hid", "hdir").distinct()
    return own.unionByName(heads.select(F.col("hid").alias("id"), F.col("hdir").alias("dir"), "hid", "hdir", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("ovl")))


def compress_chains(nodes: DataFrame, edges: DataFrame, *, max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with every chain as one node: overlaps once, coverage weighted by length, outer edges of both ends led over."""
    link = rest = None
    if "deg" in edges.columns and dict(edges.dtypes)["src"] == "bigint":
        told = cut(sides.told(edges), "links")
        link, rest = told.filter("link"), told.filter("NOT link").unionByName(edges.filter("deg > 1").select(*EDGE, F.lit(False).alias("link")))
    made, moved = merged_chains(nodes, edges, max_rounds=max_rounds, link=link, rest=rest)
    return made.drop("members"), moved


def merged_chains(nodes: DataFrame, edges: DataFrame, *, max_rounds: int = 64, link: DataFrame | None = None, rest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``compress_chains``, and for each node the nodes that became it (members). ``link``: the compressible links, where they have been written already; ``rest``: all other edges, where these have been."""
    places, shut = _places(cut(compressible(edges), "links") if link is None else link, max_rounds)
    places = cut(places, "places")
    ends = places.groupBy("hid", "hdir").agg(F.max_by(F.struct("id", "dir"), "pos").alias("tail"), F.max("pos").alias("last"))
    ends = ends.filter(F.col("last") > 0).select("hid", "hdir", F.col("tail.id").alias("tid"), F.col("tail.dir").alias("tdir"))
    forward = F.when(F.col("hid") <= F.col("tid"), F.col("hdir")).otherwise(F.col("tdir")) == "f"
    chosen = cut(ends.filter(forward).withColumn("contig", F.least("hid", "tid")), "chains")
    members = places.join(chosen.select("hid", "hdir", "contig"), ["hid", "hdir"])
    parts = members.join(nodes.withColumnRenamed("node_id", "id").select("id", "seq", "cov"), "id")
    piece = F.struct("pos", F.substr(oriented("seq", "dir"), F.col("ovl") + 1).alias("s"))
    made = parts.groupBy("contig").agg(F.array_sort(F.collect_list(piece)).alias("ps"), F.sum(F.col("cov") * F.length("seq")).alias("weight"))
    made = made.select(F.col("contig").alias("node_id"), F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("seq"), "weight", F.size("ps").cast("long").alias("members"))
    made = made.select("node_id", "seq", (F.col("weight") / F.length("seq")).alias("cov"), "members")
    single = nodes.select("node_id", "seq", "cov", F.lit(1).cast("long").alias("members")).join(members.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_anti")
    if rest is not None:
        # A link is the only edge to its end, so no other edge leads to an inner vertex.
        outer = rest.select(*EDGE) if shut is None else rest.select(*EDGE).unionByName(shut)
    else:
        joints = members.filter(F.col("pos") > 0).select(F.col("id").alias("dst"), F.col("dir").alias("dst_dir"))
        inner = joints.union(_mirror(members, chosen))
        outer = edges.join(inner.distinct(), ["dst", "dst_dir"], "left_anti")
    leave = chosen.select(F.col("tid").alias("src"), F.col("tdir").alias("src_dir"), F.col("contig").alias("c"), F.lit("f").alias("cd")).union(chosen.select("hid", flip_dir("hdir"), "contig", F.lit("r")))
    enter = chosen.select(F.col("hid").alias("dst"), F.col("hdir").alias("dst_dir"), F.col("contig").alias("c2"), F.lit("f").alias("cd2")).union(chosen.select("tid", flip_dir("tdir"), "contig", F.lit("r")))
    moved = outer.join(leave, ["src", "src_dir"], "left").join(enter, ["dst", "dst_dir"], "left")
    moved = moved.select(F.coalesce("c", "src").alias("src"), F.coalesce("cd", "src_dir").alias("src_dir"), F.coalesce("c2", "dst").alias("dst"), F.coalesce("cd2", "dst_dir").alias("dst_dir"), "ovl")
    return single.unionByName(made), moved.select(*EDGE)


def _mirror(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Vertices of the other strand that a link of the chain leads to: all but that strand's head, the flipped tail."""
    tails = chosen.select(F.col("tid").alias("id"), F.col("tdir").alias("dir"))
    return members.join(tails, ["id", "dir"], "left_anti").select(F.col("id").alias("dst"), flip_dir("dir").alias("dst_dir"))
