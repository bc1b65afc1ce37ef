"""k-mer tables: counts, histogram, stop list, read trust, corrections.

Windows leave out the last one of each read, as the counts this follows do;
``last=True`` takes it in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions.dna import rc_strict
from helixframe.operators.crowded import crowded_keys
from helixframe.plans.scratch import cut
from helixframe.plans.ship import arrow

#: Windows of a block; a window is cut from its block, as reaching into a text takes time by the distance.
BLOCK = 512


def windows(nodes: DataFrame, k: int, *keep: str, last: bool = False) -> DataFrame:
    """(keep, n, i, fk, rk): each window's place, its text and that of the other strand, which is turned over once a block."""
    n = F.length("seq")
    some = nodes.filter(n >= k + (0 if last else 1)).select(*keep, n.alias("n"), "seq")
    top = F.col("n") - k - (0 if last else 1)
    blocks = some.select(*keep, "n", "seq", F.explode(F.sequence(F.lit(0), top, F.lit(BLOCK))).alias("b"))
    t = F.substr("seq", F.col("b") + 1, F.lit(BLOCK + k - 1))
    blocks = blocks.select(*keep, "n", "b", t.alias("t"), rc_strict(t).alias("u"), F.least(F.lit(BLOCK - 1), top - F.col("b")).alias("z"))
    at = blocks.select(*keep, "n", "b", "t", "u", F.explode(F.sequence(F.lit(0), F.col("z"))).alias("j"))
    other = F.length("u") - k - F.col("j") + 1
    return at.select(*keep, "n", (F.col("b") + F.col("j")).alias("i"), F.substr("t", F.col("j") + 1, F.lit(k)).alias("fk"), F.substr("u", other, F.lit(k)).alias("rk"))


#: Bases of a minimiser at most; windows of a piece, and bases that are worked on at once; runs of a minimiser from which its windows are counted apart.
MINIMISER, PIECE, AT_ONCE, MANY_RUNS = 11, 4096, 1 << 20, 1_000_000
CODE = np.full(256, 0, np.uint64)
CODE[list(b"ACGT")] = range(4)


def runs_of(raw: np.ndarray, offsets: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, windows, minimiser) of each run of neighbouring windows with one minimiser, for texts that lie in ``raw`` one after another; a run begins at ``begin`` in text number ``text``."""
    n, lens = len(raw), np.diff(offsets)
    code = CODE[raw]
    size = max(0, n - m + 1)
    ahead, back = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    for j in range(m):
        c = code[j : j + size]
        ahead = ahead << np.uint64(2) | c
        back |= (np.uint64(3) - c) << np.uint64(2 * j)
    # Multiplied, so that the least isn't that of long rows of A.
    mixed = np.minimum(ahead, back) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    size = max(0, n - k + 1)
    least = mixed[:size].copy()
    for j in range(1, k - m + 1):
        np.minimum(least, mixed[j : j + size], out=least)
    own = np.repeat(np.arange(len(lens)), lens)[:size]
    place = np.arange(size) - offsets[own]
    valid = place <= lens[own] - k
    new = valid & (place == 0)
    new[1:] |= valid[1:] & (least[1:] != least[:-1])
    begin = np.flatnonzero(new)
    windows = np.bincount(np.cumsum(new)[valid] - 1, minlength=len(begin))
    return own[begin], begin, windows, least[begin].view(np.int64)


def super_kmers(nodes: DataFrame, k: int, *keep: str, last: bool = False) -> DataFrame:
    """(keep, mini, seq): of each text the runs of windows that have one minimiser, as one row with the bases that they cover.

    A window's minimiser is the least, in a mixed order, of the canonical m-mers
    in it, so that a k-mer and its other strand have the same one wherever they
    are: all of a k-mer's windows meet under its minimiser, and neighbouring
    windows, which mostly share one, travel together.
    """
    m = min(MINIMISER, k)
    n = F.length("seq")
    some = nodes.filter(n >= k + (0 if last else 1))
    top = n - k - (0 if last else 1)
    pieces = some.select(*keep, "seq", top.alias("top"), F.explode(F.sequence(F.lit(0), top, F.lit(PIECE))).alias("b"))
    pieces = pieces.select(*keep, F.substr("seq", F.col("b") + 1, F.least(F.lit(PIECE), F.col("top") - F.col("b") + 1) + k - 1).alias("seq"))

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = max(1, AT_ONCE // (PIECE + k)) if b.nbytes > AT_ONCE else max(1, b.num_rows)
            for i in range(0, b.num_rows, at):
                part = b.slice(i, at)
                seq = part.column(len(keep)).cast(pa.binary())
                offsets = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64)
                raw = np.frombuffer(seq.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                text, begin, windows, mini = runs_of(raw, offsets - offsets[0], k, m)
                size = windows + k - 1
                ends = np.concatenate(([0], np.cumsum(size)))
                bases = raw[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
                seqs = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(bases))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(text)) for c in part.columns[:-1]), pa.array(mini), seqs], [*keep, "mini", "seq"])

    schema = T.StructType([*pieces.select(*keep).schema.fields, T.StructField("mini", T.LongType()), T.StructField("seq", T.StringType())])
    return arrow(pieces, cut_up, schema)


#: Bases that fit into a long; parts to which minimisers are dealt, one of which a task counts at once; bases that a task packs at once, windows that it adds up at once, and rows of a batch it gives.
CODED, PARTS, PACKED_AT_ONCE, ADDED_AT_ONCE, GIVEN = 31, 4096, 2 << 20, 4 << 20, 1 << 16
#: Bases by which a k-mer is longer than its minimiser at most: so many k-mers as have one minimiser, 11 * 4^10, a task holds.
BEYOND = 10
_ACGT = np.frombuffer(b"ACGT", np.uint8)


def parts(mini: np.ndarray) -> np.ndarray:
    """The part that each minimiser is dealt to."""
    return (mini.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % PARTS


def _bundles(b: pa.RecordBatch, k: int, m: int, runs: Callable[..., tuple] = runs_of, ends_told: bool = False) -> pa.RecordBatch:
    """(part, data) of (cov, seq): the runs that go to one part, at two bits a base. A run's minimiser says where it goes.

    With a third column, ids, these follow in data. ``ends_told``: cov is four times
    itself, and 1 and 2 more where the text begins and ends a read; a run has these if
    it begins and ends the text.
    """
    seq = b.column(1).cast(pa.binary())
    offsets = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64)
    raw = np.frombuffer(seq.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    text, begin, windows, mini = runs(raw, offsets - offsets[0], k, m)
    part, cov = parts(mini), b.column(0).to_numpy(zero_copy_only=False)[text]
    if ends_told:
        first, last = np.diff(text, prepend=-1) != 0, np.diff(text, append=len(b)) != 0
        cov = cov & ~np.where(first, 0, 1) & ~np.where(last, 0, 2)
    order = np.argsort(part, kind="stable")
    text, begin, windows, part, cov = text[order], begin[order], windows[order], part[order], cov[order]
    size = windows + k - 1
    ends = np.concatenate(([0], np.cumsum(size)))
    first = np.flatnonzero(np.diff(part, prepend=-1))
    last = np.append(first[1:], len(part))
    # Each part's bases begin with a byte of their own.
    filled = -(-(ends[last] - ends[first]) // 4)
    at = np.concatenate(([0], np.cumsum(filled)))
    place = np.arange(ends[-1]) + np.repeat(4 * at[:-1] - ends[first], ends[last] - ends[first])
    four = np.zeros(4 * at[-1], np.uint8)
    four[place] = CODE[raw[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]]
    four = four.reshape(-1, 4)
    packed = (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes()
    windows, data = windows.astype("<u2"), []
    for i, j, x, y in zip(first.tolist(), last.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = cov[i:j]
        width = 1 if own.max() < 1 << 8 and own.min() >= 0 else 8
        data.append(b"".join(((j - i).to_bytes(4, "little"), bytes((width,)), windows[i:j].tobytes(), own.astype("<i8" if width == 8 else "u1").tobytes(), packed[x:y])))
    if b.num_columns > 2:
        ids = b.column(2).cast(pa.binary()).take(pa.array(text))
        sizes = pc.binary_length(ids).cast(pa.int64()).fill_null(ABSENT).to_numpy(zero_copy_only=False).astype("<u4")
        at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        letters = bytes(ids.buffers()[2] or b"")
        data = [b"".join((len(x).to_bytes(4, "little"), x, sizes[i:j].tobytes(), letters[at[i] : at[j]])) for x, i, j in zip(data, first.tolist(), last.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(data, pa.binary())], ["part", "data"])


#: The length that stands for an id that is null.
ABSENT = 0xFFFFFFFF


def _named(data: list[bytes]) -> tuple[list[bytes], pa.Array]:
    """Bundles with ids, without these; and the id of each run."""
    cores, sizes, letters = [], [], []
    for x in data:
        at = 4 + int.from_bytes(x[:4], "little")
        n = int.from_bytes(x[4:8], "little")
        cores.append(x[4:at])
        sizes.append(np.frombuffer(x, "<u4", n, at))
        letters.append(x[at + 4 * n :])
    size = np.concatenate(sizes)
    absent = size == ABSENT
    ends = np.concatenate(([0], np.cumsum(np.where(absent, 0, size), dtype=np.int64)))
    ids = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(b"".join(letters)))
    return cores, pc.if_else(pa.array(absent), pa.scalar(None, pa.large_string()), ids)


def _opened(data: list[bytes], k: int, whole: bool = False) -> tuple[np.ndarray, ...]:
    """(k-mer, coverage) of each window in bundles; k-mers as numbers, the lesser of both strands. ``whole``: (k-mer, coverage, run, windows), k-mers as they are read; the coverage is the run's, of each of which the windows follow."""
    windows, cov, begins, packed, at = [], [], [], [], 0
    for x in data:
        n, width = int.from_bytes(x[:4], "little"), x[4]
        w = np.frombuffer(x, "<u2", n, 5).astype(np.int64)
        size = w + k - 1
        windows.append(w)
        cov.append(np.frombuffer(x, "<i8" if width == 8 else "u1", n, 5 + 2 * n).astype(np.int64))
        begins.append(np.cumsum(size) - size + at)
        packed.append(np.frombuffer(x, np.uint8, -1, 5 + (2 + width) * n))
        at += 4 * len(packed[-1])
    windows, cov, begins = np.concatenate(windows), np.concatenate(cov), np.concatenate(begins)
    four = np.concatenate(packed)
    code = np.stack([four >> 6, four >> 4 & 3, four >> 2 & 3, four & 3], 1).reshape(-1).astype(np.uint64)
    # Codes of 1, 2, 4, ... bases; those that k is made of, one behind the other.
    ahead, done, length = None, 0, 1
    while True:
        if k & length:
            tail = code[done:]
            ahead = tail.copy() if ahead is None else ahead[: len(tail)] << np.uint64(2 * length) | tail
            done += length
        if 2 * length > k:
            break
        code = code[:-length] << np.uint64(2 * length) | code[length:]
        length *= 2
    ends = np.cumsum(windows)
    ahead = ahead[np.repeat(begins - (ends - windows), windows) + np.arange(ends[-1])]
    if whole:
        return ahead, cov, np.repeat(np.arange(len(windows)), windows), windows
    return np.minimum(ahead, turned(ahead, k)), np.repeat(cov, windows)


def turned(code: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the other strand's k-mers."""
    x = ~code
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = (x >> np.uint64(shift) & np.uint64(mask)) | (x & np.uint64(mask)) << np.uint64(shift)
    x = x >> np.uint64(32) | x << np.uint64(32)
    return x >> np.uint64(64 - 2 * k)


def _texts(code: np.ndarray, k: int) -> pa.Array:
    bases = np.empty((len(code), k), np.uint8)
    for j in range(k):
        bases[:, j] = _ACGT[(code >> np.uint64(2 * (k - 1 - j)) & np.uint64(3)).astype(np.uint8)]
    return pa.StringArray.from_buffers(len(code), pa.py_buffer((np.arange(len(code) + 1) * k).astype(np.int32)), pa.py_buffer(bases))


def _added(code: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number once, with its sum."""
    if not len(code):
        return code, cov
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.add.reduceat(cov[order], first)


def _bundled(nodes: DataFrame, k: int, last: bool, *ids: str, runs: Callable[..., tuple] = runs_of, ends_told: bool = False, more: DataFrame | None = None) -> DataFrame:
    """(part, data): ``super_kmers``, many in a row. What a task has at hand goes to ``PARTS`` parts as a row for each. ``ids``: a column that goes with each run. ``more``: texts (cov, seq) that are sent beside those of the nodes."""
    m = min(k, max(MINIMISER, k - BEYOND))
    n = F.length("seq")
    top = n - k - (0 if last else 1)
    pieces = _covered(nodes).filter(n >= k + (0 if last else 1)).select("cov", "seq", top.alias("top"), F.explode(F.sequence(F.lit(0), top, F.lit(PIECE))).alias("b"), *ids)
    cov = F.coalesce("cov", F.lit(0))
    if ends_told:
        cov = 4 * cov + F.when(F.col("b") == 0, 1).otherwise(0) + F.when(F.col("top") - F.col("b") < PIECE, 2).otherwise(0)
    pieces = pieces.select(cov.cast("long").alias("cov"), F.substr("seq", F.col("b") + 1, F.least(F.lit(PIECE), F.col("top") - F.col("b") + 1) + k - 1).alias("seq"), *ids)
    if more is not None:
        pieces = pieces.unionByName(more)

    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            at = max(1, PACKED_AT_ONCE // (PIECE + k)) if b.nbytes > 2 * PACKED_AT_ONCE else max(1, b.num_rows)
            for i in range(0, b.num_rows, at):
                held.append(b.slice(i, at))
                if sum(x.nbytes for x in held) >= PACKED_AT_ONCE:
                    yield _bundles(pa.concat_batches(held), k, m, runs, ends_told)
                    held = []
        if held:
            yield _bundles(pa.concat_batches(held), k, m, runs, ends_told)

    return arrow(pieces, bundle, "part int, data binary")


def _dealt_counts(nodes: DataFrame, k: int, last: bool, both: bool, above: int | None, tally: bool = False) -> DataFrame:
    """(kmer, cnt): coverage of each k-mer beyond ``above``, of both strands or of the lesser one. ``tally``: (cnt, n_kmers), how many k-mers a part has of each coverage.

    One exchange, of runs at two bits a base, many in a row. A task adds up one part
    after another, as numbers; of a minimiser of very many runs it holds a row for
    each k-mer, of which there are few, and not for each window.
    """

    def given(code: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        if above is not None:
            code, total = code[total > above], total[total > above]
        if tally:
            own = code == turned(code, k) if k % 2 == 0 else np.zeros(len(code), bool)
            found, n = np.unique(np.concatenate((2 * total[own], *[total[~own]] * (2 if both else 1))), return_counts=True)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["cnt", "n_kmers"])
            return
        for i in range(0, len(code), GIVEN):
            c, s = code[i : i + GIVEN], total[i : i + GIVEN]
            if both:
                r = turned(c, k)
                # A k-mer that is its own reverse complement, of an even k, was counted once for two strands.
                s, other = np.where(c == r, 2 * s, s), r != c
                c, s = np.concatenate((c, r[other])), np.concatenate((s, s[other]))
            yield pa.RecordBatch.from_arrays([_texts(c, k), pa.array(s, pa.int64())], ["kmer", "cnt"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0
        code, total = np.empty(0, np.uint64), np.empty(0, np.int64)

        def add() -> tuple[np.ndarray, np.ndarray]:
            if not held:
                return code, total
            c, s = _added(*_opened(held, k))
            return _added(np.concatenate((code, c)), np.concatenate((total, s))) if len(code) else (c, s)

        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part or size > ADDED_AT_ONCE:
                    code, total = add()
                    held, size = [], 0
                    if p != part:
                        yield from given(code, total)
                        part, code, total = p, code[:0], total[:0]
                held.append(x)
                size += 4 * len(x)  # bases at most
        code, total = add()
        yield from given(code, total)

    return arrow(_bundled(nodes, k, last).repartition("part").sortWithinPartitions("part"), count, "cnt long, n_kmers long" if tally else "kmer string, cnt long")


def _counted(nodes: DataFrame, k: int, last: bool) -> DataFrame:
    """(c, s): coverage of each canonical k-mer, on one strand, for k-mers that no long holds.

    Runs are dealt by their minimiser and taken apart where they arrive: one
    exchange, of a run's bases and not of every window's. A minimiser of very many
    runs is left out of that; its windows are counted under their own k-mers,
    before and after an exchange of what that leaves.
    """
    runs = cut(super_kmers(_covered(nodes), k, "cov", last=last), "runs")
    many = crowded_keys(runs, F.col("mini"), {"n": F.lit(1)}, MANY_RUNS, runs.count())
    crowded = many is not None
    many = many.select(F.col("key").alias("mini")) if crowded else None
    few = runs.join(many, "mini", "left_anti") if crowded else runs
    total = F.sum("cov").alias("s")
    # Rows that lie by their minimiser lie by minimiser and k-mer as well.
    half = windows(few.repartition("mini"), k, "mini", "cov", last=True).groupBy("mini", F.least("fk", "rk").alias("c")).agg(total).select("c", "s")
    if not crowded:
        return half
    return half.unionByName(windows(runs.join(many, "mini", "left_semi"), k, "cov", last=True).groupBy(F.least("fk", "rk").alias("c")).agg(total))


def _covered(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("cov", F.floor("cov").cast("long"))


def _both_strands(nodes: DataFrame, k: int, last: bool) -> DataFrame:
    return windows(_covered(nodes), k, "node_id", "cov", last=last).select("node_id", "cov", F.explode(F.array("fk", "rk")).alias("kmer"))


def kmer_count(nodes: DataFrame, k: int, *, last: bool = False) -> DataFrame:
    """(kmer, cnt): coverage of each k-mer over both strands. One strand is counted, under the lesser text of the two; the other one follows."""
    if k <= CODED:
        return _dealt_counts(nodes, k, last, True, None)
    half = _counted(nodes, k, last).select("c", rc_strict("c").alias("r"), "s")
    # A k-mer that is its own reverse complement, of an even k, was counted once for two strands.
    both = F.when(F.col("c") == F.col("r"), F.array(F.struct("c", (2 * F.col("s")).alias("s")))).otherwise(F.array(F.struct("c", "s"), F.struct(F.col("r").alias("c"), "s")))
    return half.select(F.explode(both).alias("x")).select(F.col("x.c").alias("kmer"), F.col("x.s").alias("cnt"))


def kmer_histogram(counts: DataFrame) -> DataFrame:
    """(cnt, n_kmers)."""
    return counts.groupBy("cnt").agg(F.count("*").alias("n_kmers"))


def distinct_kmers(counts: DataFrame) -> DataFrame:
    """(n_kmers, diffkmer): how many k-mers there are, and how many of coverage 2 or more."""
    return counts.agg(F.count("*").alias("n_kmers"), F.count_if(F.col("cnt") >= 2).alias("diffkmer"))


def histogram(nodes: DataFrame, k: int) -> DataFrame:
    """``kmer_histogram`` of ``kmer_count``; the tasks that count tell how many k-mers they have of each coverage, and no k-mer is a row."""
    if k > CODED:
        return kmer_histogram(kmer_count(nodes, k))
    return _dealt_counts(nodes, k, False, True, None, True).groupBy("cnt").agg(F.sum("n_kmers").alias("n_kmers"))


def distinct_of(counts: DataFrame) -> DataFrame:
    """``distinct_kmers`` from a histogram."""
    n = F.col("n_kmers")
    return counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_kmers"), F.coalesce(F.sum(F.when(F.col("cnt") >= 2, n)), F.lit(0)).alias("diffkmer"))


def above(nodes: DataFrame, k: int, limit: int) -> DataFrame:
    """(key): hashes that hold those of ``heavy``, from one pass over packed runs: reads' last windows count with their coverage, and each window as one at least, which bounds both sums."""
    covered = _covered(nodes)
    return _dealt_counts(covered.withColumn("cov", F.greatest(F.lit(1), "cov")), k, True, False, limit).select(F.xxhash64("kmer").alias("key"))


def heavy(nodes: DataFrame, k: int, limit: int) -> DataFrame:
    """(key, n, covered): hashes of canonical k-mers with more windows, or more coverage without reads' last windows, than the limit.

    Every k-mer beyond the limit is under one of them, so what follows is
    worked out for these only; on most inputs there are none, and counts of packed
    runs tell so (a sketch, for k-mers that no long holds).
    """
    covered = _covered(nodes)
    w = windows(covered, k, "cov", last=True)
    inner = F.when(F.col("i") < F.col("n") - k, F.col("cov")).otherwise(0)
    if k <= CODED:
        found = cut(above(nodes, k, limit), "above")
        if not found.isEmpty():
            own = w.select(F.xxhash64(F.least("fk", "rk")).alias("key"), inner.alias("covered")).join(found, "key", "left_semi")
            return own.groupBy("key").agg(F.count("*").alias("n"), F.sum("covered").alias("covered")).filter((F.col("n") > limit) | (F.col("covered") > limit))
        return nodes.sparkSession.createDataFrame([], "key long, n long, covered long")
    long = F.greatest(F.lit(0), F.length("seq") - k + 1).cast("long")
    total = covered.agg(F.sum(long), F.sum(long * F.greatest(F.lit(1), "cov"))).first()
    found = crowded_keys(w, F.xxhash64(F.least("fk", "rk")), {"n": F.lit(1).cast("long"), "covered": inner}, limit, max(x or 0 for x in total))
    return found if found is not None else nodes.sparkSession.createDataFrame([], "key long, n long, covered long")


def high_kmers(nodes: DataFrame, k: int, up_kmer: int, *, last: bool = False, among: DataFrame | None = None) -> DataFrame:
    """(kmer): canonical k-mers whose coverage exceeds ``up_kmer``; ``among``: hashes (key) that hold all of these."""
    if among is None and k <= CODED:
        return _dealt_counts(nodes, k, last, False, up_kmer).select("kmer")
    w = windows(_covered(nodes), k, "cov", last=last).withColumn("c", F.least("fk", "rk"))
    if among is not None:
        w = w.join(among.select("key"), F.xxhash64("c") == F.col("key"), "left_semi")
    return w.groupBy(F.col("c").alias("kmer")).agg(F.sum("cov").alias("s")).filter(F.col("s") > up_kmer).select("kmer")


def _of_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
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


def _frequencies(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for data in _of_parts(batches):
        cores, ids = _named(data)
        code, cov, run, _ = _opened(cores, k, True)
        other = turned(code, k)
        own, code = code == other, np.minimum(code, other)
        names = ids.dictionary_encode(null_encoding="encode")
        read = names.indices.to_numpy()[run]
        order = np.lexsort((read, code))
        code, read, own, cov = code[order], read[order], own[order], cov[run][order]
        new = np.append(True, code[1:] != code[:-1])
        # A k-mer that is its own other strand is seen twice where it is.
        total = np.add.reduceat(np.where(own, 2 * cov, cov), np.flatnonzero(new))[np.cumsum(new) - 1]
        first = np.flatnonzero(new | np.append(True, read[1:] != read[:-1]))
        found = np.repeat(first, np.where(own[first], 1, 2))
        for i in range(0, len(found), GIVEN):
            at = found[i : i + GIVEN]
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(read[at])).cast(pa.string()), pa.array(total[at], pa.int64())], ["read_id", "freq"])


def read_kmer_freq(nodes: DataFrame, k: int = 24, *, last: bool = False) -> DataFrame:
    """(read_id, freq): for each distinct k-mer of each read, either strand, the k-mer's coverage over all reads.

    A read holds a k-mer and its other strand alike, so one strand is counted
    and joined, and each k-mer stands for both. k-mers of up to 31 bases meet in one
    exchange, of packed runs with their reads' ids, and the part that has all windows of
    a k-mer gives its frequency to each read at once.
    """
    if k <= CODED and dict(nodes.dtypes)["node_id"] == "string":
        return arrow(_bundled(nodes, k, last, "node_id").repartition("part").sortWithinPartitions("part"), lambda batches: _frequencies(batches, k), "read_id string, freq long")
    w = windows(_covered(nodes), k, "node_id", "cov", last=last).select("node_id", "cov", F.least("fk", "rk").alias("kmer"), F.when(F.col("fk") == F.col("rk"), 1).otherwise(2).alias("strands"))
    own = w.groupBy("kmer", "strands", "node_id").agg(F.sum("cov").alias("s"))
    total = own.groupBy("kmer").agg(F.sum(F.col("s") * (3 - F.col("strands"))).alias("freq"))
    found = own.select("kmer", "strands", "node_id").join(total, "kmer")
    return found.select(F.col("node_id").alias("read_id"), "freq", F.explode(F.sequence(F.lit(1), "strands")).alias("x")).drop("x")


def trusted_reads(freq: DataFrame, threshold: int) -> DataFrame:
    """(read_id, trusted): 1 if every frequency exceeds the threshold."""
    return freq.groupBy("read_id").agg((F.min("freq") > threshold).cast("int").alias("trusted"))


def tag_trusted(nodes: DataFrame, trust: DataFrame) -> DataFrame:
    """``nodes`` with is_trusted; a node without a verdict isn't."""
    t = trust.select(F.col("read_id").alias("node_id"), "trusted")
    return nodes.join(t, "node_id", "left").withColumn("is_trusted", F.coalesce(F.col("trusted") == 1, F.lit(False))).drop("trusted")


ARM = 12
MINOR = 0.25


#: Bases of an arm's minimiser; corrected seeds that are told to all tasks.
ARM_MINIMISER, FEW = 8, 200_000
_RIGHT, _LEFT = np.uint64((1 << 2 * ARM) - 1), np.uint64(2 * ARM + 2)


def arm_runs(raw: np.ndarray, offsets: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``runs_of`` of windows of two arms and a base between, whose minimiser is the least of the arms' m-mers alone: all windows of a seed, whatever the base, have the same one."""
    n, lens, m = len(raw), np.diff(offsets), ARM_MINIMISER
    code = CODE[raw]
    size = max(0, n - m + 1)
    ahead, back = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    for j in range(m):
        c = code[j : j + size]
        ahead = ahead << np.uint64(2) | c
        back |= (np.uint64(3) - c) << np.uint64(2 * j)
    mixed = np.minimum(ahead, back) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    size = max(0, n - k + 1)
    least = mixed[:size].copy()
    for j in (*range(1, ARM - m + 1), *range(ARM + 1, k - m + 1)):
        np.minimum(least, mixed[j : j + size], out=least)
    own = np.repeat(np.arange(len(lens)), lens)[:size]
    place = np.arange(size) - offsets[own]
    valid = place <= lens[own] - k
    new = valid & (place == 0)
    new[1:] |= valid[1:] & (least[1:] != least[:-1])
    begin = np.flatnonzero(new)
    windows = np.bincount(np.cumsum(new)[valid] - 1, minlength=len(begin))
    return own[begin], begin, windows, least[begin].view(np.int64)


def _plain(nodes: DataFrame) -> bool:
    """Are all texts bases only?"""
    return nodes.filter(F.translate("seq", "ACGT", "") != "").isEmpty()


def _seen(code: np.ndarray, not_behind: np.ndarray, not_ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, base, window, behind): windows of 25 bases as each strand has them, but for those that it leaves out."""
    seed = code >> _LEFT << np.uint64(2 * ARM) | code & _RIGHT
    base = (code >> np.uint64(2 * ARM) & np.uint64(3)).astype(np.int64)
    fore, back = np.flatnonzero(~not_ahead), np.flatnonzero(~not_behind)
    return np.concatenate((seed[fore], turned(seed[back], 2 * ARM))), np.concatenate((base[fore], 3 - base[back])), np.concatenate((fore, back)), np.arange(len(fore) + len(back)) >= len(fore)


def _outvoted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, base, won): bases that another one outvotes between the arms of a seed."""
    for data in _of_parts(batches):
        code, cov, run, windows = _opened(data, 2 * ARM + 1, True)
        begin = np.cumsum(windows) - windows
        first, last = np.zeros(len(code), bool), np.zeros(len(code), bool)
        first[begin[cov & 1 == 1]] = True
        last[(begin + windows - 1)[cov & 2 == 2]] = True
        seed, base, at, _ = _seen(code, first, last)
        if not len(seed):
            continue
        order = np.argsort(seed, kind="stable")
        seed, base, weight = seed[order], base[order], (cov >> 2)[run[at]][order]
        new = np.append(True, seed[1:] != seed[:-1])
        own, n = np.cumsum(new) - 1, int(new.sum())
        votes = np.zeros(4 * n, np.int64)
        np.add.at(votes, 4 * own + base, weight)
        votes, there = votes.reshape(-1, 4), np.bincount(4 * own + base, minlength=4 * n).reshape(-1, 4) > 0
        top = votes.max(1, keepdims=True)
        fine = ((votes == top).sum(1) == 1) & ((votes > 0).sum(1) > 1)
        off = fine[:, None] & there & (votes != top) & (votes / np.maximum(1, top) <= MINOR)
        s, b = np.nonzero(off)
        if len(s):
            yield pa.RecordBatch.from_arrays([pa.array(seed[new][s].view(np.int64)), pa.array(b, pa.int32()), pa.array(votes.argmax(1)[s], pa.int32())], ["seed", "base", "won"])


def _observed(batches: Iterable[pa.RecordBatch], among: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(node_id, pos, seed, base, behind) of (node_id, seq): what reads have between their arms, of seeds that are ``among`` these (sorted) if they are given."""
    k = 2 * ARM + 1
    for b in filter(len, batches):
        seq = b.column(1).cast(pa.binary())
        offsets = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64)
        raw = np.frombuffer(seq.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        letters, size = CODE[raw], max(0, len(raw) - k + 1)
        code = np.zeros(size, np.uint64)
        for j in range(k):
            code = code << np.uint64(2) | letters[j : j + size]
        lens = np.diff(offsets)
        own = np.repeat(np.arange(len(lens)), lens)[:size]
        place = np.arange(size) - offsets[own]
        whole = np.flatnonzero(place <= lens[own] - k)
        own, place = own[whole], place[whole]
        arms = code >> _LEFT << np.uint64(2 * ARM) | code & _RIGHT
        one = (arms == 0) | (arms == np.uint64((1 << 4 * ARM) - 1))
        # A strand's window of a number is left out where the window ahead of that number has arms of one letter.
        top = lens[own] - k - place
        seed, base, at, behind = _seen(code[whole], (place == 0) | one[offsets[own] + top], (top == 0) | one[whole])
        if among is not None:
            some = np.flatnonzero(among[np.minimum(np.searchsorted(among, seed), len(among) - 1)] == seed)
            seed, base, at, behind = seed[some], base[some], at[some], behind[some]
        for i in range(0, len(at), GIVEN):
            x = slice(i, i + GIVEN)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own[at[x]])), pa.array(place[at[x]] + ARM, pa.int32()), pa.array(seed[x].view(np.int64)), pa.array(base[x], pa.int32()), pa.array(behind[x])], ["node_id", "pos", "seed", "base", "behind"])


def _corrected(nodes: DataFrame) -> DataFrame:
    """``precorrect`` of texts of bases: seeds vote in one exchange of packed runs without ids, and reads look theirs up among the outvoted ones, of which a task is told up to ``FEW``."""
    k = 2 * ARM + 1
    some = nodes.filter(F.length("seq") > k)
    # Reads with arms of one letter somewhere leave more windows out than their ends; theirs are sent one by one.
    letter = "|".join(f"{b}{{{ARM}}}.{b}{{{ARM}}}" for b in "AT")
    odd, top = F.col("seq").rlike(letter), F.length("seq") - k
    by = _covered(some.filter(odd)).select(F.coalesce("cov", F.lit(0)).alias("cov"), "seq", top.alias("top"), F.explode(F.sequence(F.lit(0), top)).alias("i"))

    def one(i: Column) -> Column:
        return F.substr("seq", i + 1, F.lit(k)).rlike(f"^(?:{letter})$")

    not_behind, not_ahead = (F.col("i") == 0) | one(F.col("top") - F.col("i")), (F.col("i") == F.col("top")) | one(F.col("i"))
    by = by.select((4 * F.col("cov") + not_behind.cast("int") + 2 * not_ahead.cast("int")).cast("long").alias("cov"), F.substr("seq", F.col("i") + 1, F.lit(k)).alias("seq"))
    sent = _bundled(some.filter(~odd), k, True, runs=arm_runs, ends_told=True, more=by)
    off = cut(arrow(sent.repartition("part").sortWithinPartitions("part"), _outvoted, "seed long, base int, won int"), "outvoted")
    seeds = off.select("seed").distinct().limit(FEW + 1).collect()
    told = np.unique(np.array([x.seed for x in seeds], np.int64).view(np.uint64)) if len(seeds) <= FEW else None
    kind = dict(nodes.dtypes)["node_id"]
    if told is not None and not len(told):
        some = some.limit(0)
    own = arrow(some.select("node_id", "seq"), lambda batches: _observed(batches, told), f"node_id {kind}, pos int, seed long, base int, behind boolean")
    bad = own.join(off, ["seed", "base"])
    at = F.when(F.col("behind"), 4 - F.col("won")).otherwise(F.col("won") + 1)
    return bad.select(F.col("node_id").alias("read_id"), "pos", F.substr(F.lit("ACGT"), at, F.lit(1)).alias("base"))


def precorrect(nodes: DataFrame) -> DataFrame:
    """(read_id, pos, base): corrections where a base between two 12-base arms is outvoted 4 to 1 or more.

    Seeds come from both strands, so most corrections come twice. The votes of
    a seed are four sums, whatever the number of its reads.
    """
    if _plain(nodes):
        return _corrected(nodes)
    span = 2 * ARM + 1
    n = F.length("seq") - span
    turned = nodes.filter(n > 0).select("node_id", F.floor("cov").cast("long").alias("w"), "seq", rc_strict("seq").alias("rc"))
    at = turned.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))

    def arms(text: str) -> Column:
        return F.concat(F.substr(text, F.col("i") + 1, F.lit(ARM)), F.substr(text, F.col("i") + ARM + 2, F.lit(ARM)))

    def middle(text: str) -> Column:
        return F.substr(text, F.col("i") + ARM + 1, F.lit(1)).alias("base")

    ahead = F.struct(arms("seq").alias("seed"), F.lit("f").alias("strand"), (F.col("i") + ARM).alias("pos"), middle("seq"))
    behind = F.struct(arms("rc").alias("seed"), F.lit("r").alias("strand"), (F.length("seq") - span - F.col("i") + ARM).alias("pos"), middle("rc"))
    # Either strand is left out where the forward arms are one letter throughout.
    seen = at.filter(~arms("seq").isin("A" * 2 * ARM, "T" * 2 * ARM)).select("node_id", "w", F.explode(F.array(ahead, behind)).alias("o")).select("node_id", "w", "o.*")
    votes = seen.groupBy("seed").agg(*[F.sum(F.when(F.col("base") == b, F.col("w")).otherwise(0)).alias(b) for b in "ACGT"])
    top = F.greatest(*"ACGT")
    ties = sum((F.when(F.col(b) == top, 1).otherwise(0) for b in "ACGT"), F.lit(0))
    split = sum((F.when(F.col(b) > 0, 1).otherwise(0) for b in "ACGT"), F.lit(0))
    winner = F.coalesce(*[F.when(F.col(b) == top, F.lit(b)) for b in "ACGT"])
    votes = votes.filter((ties == 1) & (split > 1)).select("seed", *"ACGT", winner.alias("won"), top.alias("top"))
    own = F.coalesce(*[F.when(F.col("base") == b, F.col(b)) for b in "ACGT"])
    bad = seen.join(votes, "seed").filter((F.col("base") != F.col("won")) & (own / F.col("top") <= MINOR))
    fixed = F.when(F.col("strand") == "f", F.col("won")).otherwise(F.translate("won", "ACGT", "TGCA"))
    return bad.select(F.col("node_id").alias("read_id"), F.col("pos").cast("int").alias("pos"), fixed.alias("base"))
