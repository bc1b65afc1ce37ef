"""Reads to nodes: filter, collapse modulo reverse complement, check."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.dna import is_dna
from helixframe.plans.ship import arrow


def read_filter(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, seq) in upper case: bases only, longer than k."""
    up = reads.select("read_id", F.upper("seq").alias("seq"))
    return up.filter(is_dna("seq") & (F.length("seq") > k))


def read_metrics(reads: DataFrame, k: int) -> DataFrame:
    """One row of counts: lines, skipped, short, good, good bases; before them the lines that are no reads, where ``reads`` says which are (valid)."""
    s = F.upper("seq")
    ok, long = is_dna(s), F.length(s) > k
    valid = F.col("valid") if "valid" in reads.columns else F.lit(True)
    good = valid & ok & long
    counts = [
        F.count("*").alias("reads"), F.count_if(valid & ~ok).alias("reads_skipped"), F.count_if(valid & ok & ~long).alias("reads_short"),
        F.count_if(good).alias("reads_good"), F.coalesce(F.sum(F.when(good, F.length(s).cast("long"))), F.lit(0)).alias("reads_goodbp"),
    ]
    return reads.agg(*([F.count_if(~valid).alias("input_lines_invalid")] if "valid" in reads.columns else []), *counts)


#: Reads and bytes that a task combines at once before they are sent.
AT_ONCE, BYTES_AT_ONCE = 1 << 16, 8 << 20
_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = range(4)
_BASES = np.frombuffer(b"ACGT", np.uint8)
_TURN = str.maketrans("ACGT", "TGCA")
#: The first byte of the packed form of a text that isn't bases only, which follows as it is.
AS_IS = 4


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where its rows begin and end in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8), offsets - offsets[0]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])


def pack(seq: pa.Array) -> tuple[list[bytes | None], list[bool]]:
    """Of each text the lesser of it and its reverse complement, four bases a byte behind the number of bases in the last one, and whether it was turned over."""
    raw, offsets = _spans(seq.cast(pa.binary()))
    code, lens = _CODE[raw], np.diff(offsets)
    begin = np.repeat(offsets[:-1], lens)
    other = (3 - code)[2 * begin + np.repeat(lens, lens) - 1 - np.arange(len(raw))]
    differ = np.append(np.flatnonzero(code != other), len(raw))
    first = differ[np.searchsorted(differ, offsets[:-1])]
    turned = np.zeros(len(lens), bool)
    inside = first < offsets[1:]
    turned[inside] = other[first[inside]] < code[first[inside]]
    own = np.where(np.repeat(turned, lens), other, code)
    size = -(-lens // 4)
    ends = np.concatenate(([0], np.cumsum(size)))
    four = np.zeros(4 * ends[-1], np.uint8)
    four[np.arange(len(raw)) + np.repeat(4 * ends[:-1] - offsets[:-1], lens)] = own
    four = four.reshape(-1, 4)
    packed = (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes()
    keys: list[bytes | None] = [bytes((m,)) + packed[i:j] for m, i, j in zip((lens % 4).tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    odd = set(np.searchsorted(offsets, np.flatnonzero(code == 4), "right").tolist()) if (code == 4).any() else set()
    odd |= {i + 1 for i in np.flatnonzero(seq.is_null().to_numpy(zero_copy_only=False)).tolist()}
    for i in odd:
        text = seq[i - 1].as_py()
        back = text and text.translate(_TURN)[::-1].encode()
        turned[i - 1] = bool(text) and back < text.encode()
        keys[i - 1] = None if text is None else bytes((AS_IS,)) + (back if turned[i - 1] else text.encode())
    return keys, turned.tolist()


def unpack(keys: pa.Array, turned: np.ndarray) -> pa.Array:
    """The texts that ``pack`` was given."""
    raw, offsets = _spans(keys)
    some = np.diff(offsets) > 0  # not null
    left = np.zeros(len(some), np.int64)
    left[some] = raw[offsets[:-1][some]]
    size = np.maximum(np.diff(offsets) - 1, 0)
    size[left == AS_IS] = 0
    lens = 4 * size - np.where((left > 0) & (left < AS_IS), 4 - left, 0)
    ends = np.concatenate(([0], np.cumsum(lens)))
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], lens)
    place = np.where(np.repeat(turned, lens), np.repeat(lens, lens) - 1 - place, place)
    code = raw[np.repeat(offsets[:-1] + 1, lens) + place // 4] >> (6 - 2 * (place % 4)).astype(np.uint8) & 3
    made = _binary(_BASES[np.where(np.repeat(turned, lens), 3 - code, code)], lens).cast(pa.string())
    if not some.all() or (left == AS_IS).any():
        out = made.to_pylist()
        for i in np.flatnonzero(~some | (left == AS_IS)).tolist():
            text = keys[i].as_py()
            out[i] = None if text is None else text[1:].decode().translate(_TURN)[::-1] if turned[i] else text[1:].decode()
        return pa.array(out, pa.string())
    return made


def _combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, read_id, turned, n) of (read_id, seq): of equal reads that are at hand at once the least id and their number."""

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.concat_batches(held)
        keys, turned = pack(b.column(1))
        ids = b.column(0).cast(pa.binary()).to_pylist()
        best: dict[bytes | None, int] = {}
        n = [1] * len(keys)
        for i, k in enumerate(keys):
            j = best.setdefault(k, i)
            if j != i:
                n[i] += n[j]
                least = min(i, j, key=lambda x: (ids[x] is not None, ids[x] or b"", turned[x]))
                n[least] = n[i]
                best[k] = least
        at = list(best.values())
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at], pa.binary()), b.column(0).take(pa.array(at, pa.int64())), pa.array([turned[i] for i in at], pa.bool_()), pa.array([n[i] for i in at], pa.int64())], ["c", "read_id", "turned", "n"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= AT_ONCE or sum(x.nbytes for x in held) >= BYTES_AT_ONCE:
            yield one(held)
            held = []
    if held:
        yield one(held)


def _restored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column(0), unpack(b.column(1), b.column(2).to_numpy(zero_copy_only=False)), b.column(3)], ["node_id", "seq", "cov"])


def read_dedup(reads: DataFrame) -> DataFrame:
    """(node_id, seq, cov): equal reads, either strand, as one node.

    One exchange, of two bits a base: a task combines what it has at once, in
    memory, and sends the least id of each distinct sequence with the number of
    its reads and whether that read is turned over. Nothing is sorted before it
    is sent.
    """
    return arrow(_collapsed(reads), _restored, "node_id string, seq string, cov double")


def _collapsed(reads: DataFrame) -> DataFrame:
    """(node_id, c, turned, cov): the nodes of ``read_dedup``, packed."""
    sent = arrow(reads.select(F.col("read_id").cast("string").alias("read_id"), "seq"), _combined, "c binary, read_id string, turned boolean, n long")
    # Dealt out first: what an aggregate of texts does before its exchange is a sort of all rows.
    own = sent.repartition("c").groupBy("c").agg(F.min(F.struct("read_id", "turned")).alias("x"), F.sum("n").cast("double").alias("cov"))
    return own.select(F.col("x.read_id").alias("node_id"), "c", F.col("x.turned").alias("turned"), "cov")


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node_id, seq, cov, name, first) of a range of (node_id, c, turned, cov) in the order of ids: a number for each id, and whether a row is the first of its id."""
    at, last = (TaskContext.get().partitionId() << ROW_BITS) - 1, None
    for b in filter(len, batches):
        name = b.column(0)
        new = np.ones(len(name), bool)
        new[1:] = pc.not_equal(name.slice(1), name.slice(0, len(name) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
        new[0] = last is None or last != name[0].as_py()
        number = at + np.cumsum(new)
        at, last = int(number[-1]), name[-1].as_py()
        absent = name.is_null().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64(), mask=absent), unpack(b.column(1), b.column(2).to_numpy(zero_copy_only=False)), b.column(3), name, pa.array(new & ~absent)], ["node_id", "seq", "cov", "name", "first"])


#: A number's lowest bits, which count a range's ids.
ROW_BITS = 33


def numbered_dedup(reads: DataFrame) -> DataFrame:
    """(node_id, seq, cov, name, first): ``read_dedup``, with numbers as ids, in the order of the ids (name), which are alike where these are.

    Whatever is compared, counted or chosen by id comes out the same by number, without
    a text in any exchange. Ids that are neighbours have numbers that are. ``first``
    holds for one row of each id. Not the same numbers in another run: to be written.
    """
    return arrow(_collapsed(reads).repartitionByRange("node_id").sortWithinPartitions("node_id"), _numbered, "node_id long, seq string, cov double, name string, first boolean")


def named(df: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the ids of ``numbered_dedup``'s nodes in the place of the numbers in ``columns``."""
    names = nodes.filter("first")
    for c in columns:
        df = df.join(names.select(F.col("node_id").alias(c), F.col("name").alias(f"{c}_name")), c, "left").withColumn(c, F.col(f"{c}_name")).drop(f"{c}_name")
    return df


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, read_id, turned, ids, turns) of (read_id, seq): equal reads that are at hand at once as one row, the least id first and then the others."""

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.concat_batches(held)
        keys, flags = pack(b.column(1))
        ids, turned = b.column(0), np.array(flags, bool)
        coded = pa.array(keys, pa.binary()).dictionary_encode()
        own = coded.indices.to_numpy()
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=len(coded.dictionary))
        begin = np.cumsum(counts) - counts
        for i, n in zip(begin[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
            names = ids.take(pa.array(order[i : i + n])).to_pylist()
            least = min(range(n), key=lambda j: (names[j] is None, (names[j] or "").encode(), flags[order[i + j]]))
            order[[i, i + least]] = order[[i + least, i]]
        rest = np.delete(order, begin)
        ends = pa.array(np.concatenate(([0], np.cumsum(counts - 1))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(pa.array(rest)), pa.array(turned[rest]))]
        return pa.RecordBatch.from_arrays([coded.dictionary, ids.take(pa.array(order[begin])), pa.array(turned[order[begin]]), *lists], ["c", "read_id", "turned", "ids", "turns"])

    held: list[pa.RecordBatch] = []
    for b in filter(len, batches):
        held.append(b)
        if sum(x.num_rows for x in held) >= AT_ONCE or sum(x.nbytes for x in held) >= BYTES_AT_ONCE:
            yield one(held)
            held = []
    if held:
        yield one(held)


_MEMBER = ["node_id", "read_id", "c", "turned", "n"]


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node_id, read_id, c, turned, n) of rows of ``_gathered`` in the order of c and id: every read with the least id of its equals, and for reads of this id their number. A group may reach over any number of batches; of it only the reads with the least id wait for its end."""
    last: tuple[bytes, str, int, list[bool]] | None = None  # c, least id, reads, and those of this id: turned or not

    def rest() -> pa.RecordBatch:
        c, least, n, flags = last
        k = len(flags)
        return pa.RecordBatch.from_arrays([pa.array([least] * k, pa.string()), pa.array([least] * k, pa.string()), pa.array([c] * k, pa.binary()), pa.array(flags, pa.bool_()), pa.array([n] * k, pa.int64())], _MEMBER)

    for b in filter(len, batches):
        c = b.column(0)
        new = np.ones(len(c), bool)
        new[1:] = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        goes_on = last is not None and last[0] == c[0].as_py()
        least = b.column(1).take(pa.array(begin))
        if goes_on:
            least = pa.concat_arrays([pa.array([last[1]], pa.string()), least.slice(1)])
        elif last is not None:
            yield rest()
        row = np.concatenate((np.arange(len(c)), np.repeat(np.arange(len(c)), pc.list_value_length(b.column(3)).to_numpy())))
        ids = pa.concat_arrays([b.column(1), b.column(3).flatten()])
        turned = pa.concat_arrays([b.column(2), b.column(4).flatten()])
        own = group[row]
        n = np.bincount(own, minlength=len(begin))
        if goes_on:
            n[0] += last[2]
        node = least.take(pa.array(own))
        first = pc.fill_null(pc.equal(ids, node), False).to_numpy(zero_copy_only=False)
        if goes_on and len(begin) > 1:
            last = (*last[:2], int(n[0]), last[3])
            yield rest()
        waits = first & (own == len(begin) - 1)
        flags = turned.filter(pa.array(waits)).to_pylist()
        last = (c[-1].as_py(), least[-1].as_py(), int(n[-1]), [*last[3], *flags] if goes_on and len(begin) == 1 else flags)
        yield pa.RecordBatch.from_arrays([node, ids, c.take(pa.array(row)), turned, pa.array(np.where(first, n[own], 1))], _MEMBER).filter(pa.array(~waits))
    if last is not None:
        yield rest()


def members(reads: DataFrame) -> DataFrame:
    """(node_id, read_id, c, turned, n): each read with the least id of its equals, either strand, and its text, packed (c) and perhaps turned over. n: for reads of that id the number of all, else 1.

    One exchange, at two bits a base. Equal reads that a task has at once are one
    row, so a read repeated a million times is few of them.
    """
    some = reads.filter(F.col("seq").isNotNull()).select(F.col("read_id").cast("string").alias("read_id"), "seq")
    sent = arrow(some, _gathered, "c binary, read_id string, turned boolean, ids array<string>, turns array<boolean>")
    return arrow(sent.repartition("c").sortWithinPartitions("c", "read_id"), _members, "node_id string, read_id string, c binary, turned boolean, n long")


def mark_contained(reads: DataFrame) -> DataFrame:
    """(read_id, seq, cov, contained): the least id of equal reads, either strand, stands for all and has their number as coverage."""
    own = members(reads).select("read_id", "c", "turned", F.col("n").cast("double").alias("cov"), (F.col("read_id") != F.col("node_id")).alias("contained"))

    def restore(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            yield pa.RecordBatch.from_arrays([b.column(0), unpack(b.column(1), b.column(2).to_numpy(zero_copy_only=False)), b.column(3), b.column(4)], ["read_id", "seq", "cov", "contained"])

    return arrow(own, restore, "read_id string, seq string, cov double, contained boolean")


def redundant_removal(marked: DataFrame, *, check: bool = True) -> DataFrame:
    """(node_id, seq, cov) of reads that aren't contained; an id twice is an error."""
    kept = marked.filter(~F.col("contained")).select(F.col("read_id").alias("node_id"), "seq", "cov")
    if not check:
        return kept

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            keys, turned = pack(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(turned, pa.bool_()), b.column(2)], ["node_id", "c", "turned", "cov"])

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in filter(len, batches):
            ids = b.column(0)
            again = np.flatnonzero(pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)).fill_null(True).to_numpy(zero_copy_only=False))
            if len(again) or last is not None and last == ids[0]:
                raise ValueError(f"not exactly one node: {ids[int(again[0])] if len(again) else last}")
            last = ids[-1]
            yield from _restored([b])

    names = kept.dtypes[0][1]
    sent = arrow(kept.withColumn("cov", F.col("cov").cast("double")), send, f"node_id {names}, c binary, turned boolean, cov double")
    return arrow(sent.repartition("node_id").sortWithinPartitions("node_id"), once, f"node_id {names}, seq string, cov double")


def count_reads(nodes: DataFrame, node_reads: DataFrame | None = None) -> DataFrame:
    """(reads, ctg_sum): reads behind the nodes and the nodes' bases."""
    total = nodes.agg(F.coalesce(F.sum("cov"), F.lit(0.0)).cast("long").alias("reads"), F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0)).alias("ctg_sum"))
    if node_reads is None:
        return total
    return total.drop("reads").crossJoin(node_reads.agg(F.count("*").alias("reads"))).select("reads", "ctg_sum")  # one row by one row
