"""Removal of repeated byte strings: every byte goes that a ``length``-byte string covers which also starts earlier.

Earlier is: in a document of a smaller id, or before in the same document.
Strings are judged on the input, so of equal strings exactly the first stays.

1. Each window of ``length`` bytes chooses the least of its 32-byte grams'
   hashes as its anchor. Equal windows choose equal anchors, so they meet under
   one hash; a run of windows with one anchor is a segment.
2. Segments of equal bytes under an anchor are all repeats but for the first.
   The first ones of anchors that have several different segments go on.
3. Their bytes are fetched and dealt to shards by anchor. A shard's suffixes are
   put in order by induced sorting: the suffixes at the valleys of the text are
   sorted by their substrings' names, and all others are induced from them,
   bucket by bucket, through queues that go to disk when they outgrow their
   share of memory. Neighbours in that order with a common prefix of ``length``
   bytes are equal windows; the first one of each stays. An anchor with more
   segments than a task should hold is split by the bytes around it first, in
   the last step by whole windows.
4. Each document is joined with its repeats and cut.

Null texts have no bytes. Rows of equal id and equal text are one document,
reported alike; rows of equal id and other texts are ordered by their hash, and
null ids come first.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import by_batch, release, table, utf8, without
from helixframe.plans.scratch import cut

GRAM = 32
#: Windows of a text whose anchors are chosen at a time.
BLOCK = 1 << 20
#: Bytes of a shard from which a new one is begun, if the anchor changes.
SHARD = 6 << 20
#: Segments of one anchor beyond which it is split by the bytes around it.
CROWD = 2_000
#: Entries of a shard's queue that are held in memory, a fraction of a shard's.
HELD = 1 << 18


def _mix() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """The hash of the 32 bytes from each byte on: five rounds put together neighbours of 1, 2, 4, 8 and 16 bytes."""
    r, step, factor = mixed[data], 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        r = r[:-step] * np.uint64(factor) + r[step:]
        step, factor = 2 * step, factor * factor & 0xFFFFFFFFFFFFFFFF
    r ^= r >> np.uint64(32)
    r *= np.uint64(0xD6E8FEB86659FD93)
    return r ^ (r >> np.uint64(32))


def least_places(x: np.ndarray, width: int) -> np.ndarray:
    """Where the first least value of each window of ``width`` is."""
    at, value, span = np.arange(len(x)), x, 1
    while span < width:
        d = min(span, width - span)
        a, b = value[:-d], value[d:]
        later = b < a
        at, value, span = np.where(later, at[d:], at[:-d]), np.where(later, b, a), span + d
    return at


def segments(text: bytes, length: int, mixed: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(anchor's hash, first window's start, windows) of each run of windows with one anchor."""
    for a in range(0, len(text) - length + 1, BLOCK):
        part = np.frombuffer(text, np.uint8)[a : a + BLOCK + length - 1]
        g = gram_hashes(part, mixed)
        at = least_places(g, length - GRAM + 1)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        size = np.diff(np.append(new, len(at)))
        yield from zip(g[at[new]].view(np.int64).tolist(), (new + a).tolist(), size.tolist(), strict=True)


def _documents(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, th, text): the order of a row, and its bytes."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(t).alias("th"), t.alias("text"))


PLACE = "id long, th long, p long"


ROWS = "h long, c long, id long, th long, p long"


def _in_order(h: list[int], c: list[int], ids: np.ndarray, ths: np.ndarray, p: list[int]) -> pa.RecordBatch:
    """Rows of a batch in order. Segments equal to an earlier one of the batch are repeats for sure: their p is negated, and they go by a hash of their place."""
    x = np.stack([np.array(h, np.int64), np.array(c, np.uint64).view(np.int64), ids, ths, np.array(p, np.int64)])
    x = x[:, np.lexsort(x[::-1])]
    new = np.concatenate(([True], (x[:2, 1:] != x[:2, :-1]).any(0)))[: x.shape[1]]
    lead = np.maximum.accumulate(np.where(new, np.arange(x.shape[1]), 0))
    sure = ~new & (x[2:] != x[2:, lead]).any(0)
    x[0, sure] = (x[2, sure] * 31 + x[4, sure]) * 0x2545F4914F6CDD1D
    x[4, sure] = ~x[4, sure]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in x], ["h", "c", "id", "th", "p"])


def segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """(h, c, id, th, p): anchor's hash, hash of the segment's bytes, document, start and windows packed as start * 256 + windows.

    A passage of a third of all documents sends one row for each batch to its
    anchor's task; the batch's other copies are known to be repeats already.
    """

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        mixed, hash_ = _mix(), xxhash.xxh3_64_intdigest
        h, c, p, counts = [], [], [], []
        for t in utf8(b.column(2)):
            n = len(h)
            for a, s, w in segments(t, length, mixed):
                h.append(a)
                c.append(hash_(t[s : s + w + length - 1]))
                p.append(s << 8 | w)
            counts.append(len(h) - n)
        return _in_order(h, c, *(np.repeat(b.column(i).to_numpy(), counts) for i in (0, 1)), p)

    return by_batch(docs, emit, ROWS, rows=256)


def finer_rows(parts: DataFrame, length: int, span: int) -> DataFrame:
    """The rows of segments cut up by where the anchor lies in a window, in ranges of ``span`` places.

    All windows of a range share the bytes around the anchor but for ``span``
    less one, and equal windows lie in one range: the hash of these bytes is
    the new h. With a span of 1 they are the whole window.
    """

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        mixed, hash_ = _mix(), xxhash.xxh3_64_intdigest
        h, c, p, counts = [], [], [], []
        for own, start, part in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            n, w = len(h), len(part) - length + 1
            if span > 1:
                q = int(np.flatnonzero(gram_hashes(np.frombuffer(part, np.uint8), mixed).view(np.int64) == own)[0])
                for low in range((q - w + 1) // span * span, q + 1, span):
                    first, last = max(0, q - low - span + 1), min(w - 1, q - low)  # windows whose anchor lies at low to low + span - 1
                    h.append(hash_(part[max(0, q - low) : q - low - span + 1 + length], low) - (1 << 63))
                    c.append(hash_(part[first : last + length]))
                    p.append((start + first) << 8 | last - first + 1)
            else:
                for k in range(w):
                    window = part[k : k + length]
                    h.append(hash_(window, 1) - (1 << 63))
                    c.append(hash_(window))
                    p.append((start + k) << 8 | 1)
            counts.append(len(h) - n)
        return _in_order(h, c, *(np.repeat(b.column(i).to_numpy(), counts) for i in (1, 2)), p)

    return by_batch(parts, emit, ROWS, rows=4096)


def resolve(rows: DataFrame) -> DataFrame:
    """(repeat, h, id, th, p): segments equal to an earlier one of their anchor (repeat), and the first ones where an anchor has several.

    Rows come in order and stream through: a task holds a batch and the state
    of the anchor that the last one ended in, however often that anchor occurs.
    """

    def rows_of(x: np.ndarray, repeat: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(x.shape[1], repeat)), *(pa.array(x[i]) for i in (0, 2, 3, 4))], ["repeat", "h", "id", "th", "p"])

    ordered = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h").sortWithinPartitions("h", "c", "id", "th", "p")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: np.ndarray | None = None  # the first row of the last (h, c)
        waiting: np.ndarray | None = None  # the first row of the last h, while it has one segment only
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns])
            sure = x[4] < 0
            known, x = x[:, sure], x[:, ~sure]
            if known.shape[1]:
                known[4] = ~known[4]
                yield rows_of(known, True)
            if not x.shape[1]:
                continue
            new_h = np.concatenate(([first is None or x[0, 0] != first[0]], x[0, 1:] != x[0, :-1]))
            new_c = new_h | np.concatenate(([first is None or x[1, 0] != first[1]], x[1, 1:] != x[1, :-1]))
            lead = np.maximum.accumulate(np.where(new_c, np.arange(x.shape[1]), -1))
            same = np.where(lead >= 0, (x[2:] == x[2:, lead]).all(0), False if first is None else (x[2:] == first[2:, None]).all(0))
            repeat = x[:, ~new_c & ~same]
            # Of each anchor the first segment goes on only once a second one is seen.
            second = new_c & ~new_h
            group = np.cumsum(new_h)
            several = np.unique(group[second])
            go = second | (new_h & np.isin(group, several))
            on = x[:, go]
            if waiting is not None and 0 in several:
                on = np.concatenate((waiting[:, None], on), axis=1)
            starts = np.flatnonzero(new_h)
            if len(starts):
                waiting = None if group[-1] in several else x[:, starts[-1]].copy()
            elif len(several):
                waiting = None
            k = int(lead[-1])
            first = x[:, k].copy() if k >= 0 else first
            yield rows_of(repeat, True)
            yield rows_of(on, False)

    return ordered.mapInArrow(run, "repeat boolean, h long, id long, th long, p long")


class Queue:
    """A priority queue of suffixes by their first symbol, then by the order in which they come, each with its common prefix with the one before it.

    Induction puts the suffixes of a symbol in their order, so a symbol's
    entries are a run that is appended to and taken from the front: no heap is
    needed. Beyond ``held`` entries the runs go to a file.
    """

    def __init__(self, symbols: int, held: int, folder: str | None):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.size, self.held, self.folder, self.file = 0, held, folder, None
        self.spilled = 0

    def put(self, at: np.ndarray, symbol: np.ndarray, common: np.ndarray) -> None:
        """Appends each suffix to its symbol's run. All are in the order of their symbols."""
        counts = np.bincount(symbol, minlength=len(self.parts))
        ends = np.cumsum(counts)
        for c in np.flatnonzero(counts).tolist():
            self.parts[c].append((at[ends[c] - counts[c] : ends[c]], common[ends[c] - counts[c] : ends[c]]))
        self.size += len(at)
        if self.size > self.held:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(dir=self.folder)
        self.file.seek(0, os.SEEK_END)
        for parts in self.parts:
            for i, x in enumerate(parts):
                if isinstance(x[0], np.ndarray):
                    parts[i] = (self.file.tell(), len(x[0]))
                    self.file.write(np.ascontiguousarray(x[0], np.int64).tobytes())
                    self.file.write(np.ascontiguousarray(x[1], np.uint8).tobytes())
                    self.spilled += len(x[0])
        self.size = 0

    def take(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """All that is queued under a symbol, whose run is empty then."""
        parts, self.parts[c] = self.parts[c], []
        at, common = [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
        for x in parts:
            if isinstance(x[0], np.ndarray):
                self.size -= len(x[0])
                at.append(x[0])
                common.append(x[1])
            else:
                self.file.seek(x[0])
                at.append(np.frombuffer(self.file.read(8 * x[1]), np.int64))
                common.append(np.frombuffer(self.file.read(x[1]), np.uint8))
        return np.concatenate(at), np.concatenate(common)


class _Least:
    """For each symbol the least common prefix among the suffixes that were passed since one of them induced a suffix of that symbol."""

    def __init__(self, symbols: int):
        self.low = np.zeros(symbols, np.uint8)  # nothing was induced yet: the first of a symbol shares nothing with what precedes it

    def through(self, common: np.ndarray, sources: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passes suffixes with these common prefixes, of which those at ``sources`` induce suffixes of ``symbol``: their order by symbol, and for each the least prefix since the last source of its symbol."""
        order = np.argsort(symbol, kind="stable")
        s, c = sources[order], symbol[order]
        new = np.concatenate(([True], c[1:] != c[:-1]))[: len(c)]
        since = np.where(new, 0, np.concatenate(([0], s[:-1] + 1))[: len(s)])
        least = _minima(common, since, s)
        least[new] = np.minimum(least[new], self.low[c[new]])
        if len(common):
            tail = np.minimum.accumulate(common[::-1])[::-1]
            kept = np.minimum(self.low, tail[0])
            last = np.concatenate((new[1:], [True]))[: len(c)]
            at = s[last] + 1
            kept[c[last]] = np.where(at < len(common), tail[np.minimum(at, len(common) - 1)], 255)
            self.low = kept
        return order, least


def _minima(x: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The least of x[a] to x[z], for each pair, by a table of minima over powers of two."""
    out = np.full(len(a), 255, np.uint8)
    size = z - a + 1
    level, width, table = 0, 1, x
    while len(a) and width <= int(size.max()):
        here = (size >= width) & (size < 2 * width)
        out[here] = np.minimum(table[a[here]], table[z[here] - width + 1])
        if 2 * width <= len(x):
            table = np.minimum(table[:-width], table[width:])
        level, width = level + 1, 2 * width
    return out


def _runs(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(True where a suffix is less than the one after it (S), how often its first symbol stands there): by the next place where the symbols differ."""
    step = np.sign(np.diff(symbol)).astype(np.int8)
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.append(np.minimum.accumulate(at[::-1])[::-1], len(step))
    return np.append(np.append(step, 0)[at[:-1]] > 0, True), np.minimum(at - np.arange(len(symbol)) + 1, 255).astype(np.uint8)


TOP = 257


def induce(bucket: np.ndarray, s_type: np.ndarray, run: np.ndarray, valleys: np.ndarray, common: np.ndarray, cap: int, held: int, folder: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in falling order of their first symbols, each symbol's in order: (places, common prefix with the one before, up to ``cap``).

    ``bucket``: symbols with all separators as 0, whose own order is that of
    ``valleys``; ``common``: the prefixes that the valleys share with the valley
    before. L suffixes are induced upwards, then S suffixes downwards. A
    symbol's suffixes are taken from its queue in rounds; those that they induce
    under the same symbol are the next round. Two suffixes that follow each
    other under a symbol share one symbol more than their sources do, which is
    the least of what all suffixes between these share.
    """
    leads, up, down, done = (Queue(TOP, held, folder) for _ in range(4))
    order = np.argsort(bucket[valleys], kind="stable")
    leads.put(valleys[order], bucket[valleys][order], common[order])

    def more(least: np.ndarray) -> np.ndarray:
        return np.minimum(least, cap - 1) + np.uint8(1)

    def expand(queue: Queue, least: _Least, c: int, at: np.ndarray, shared: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray]:
        """Passes suffixes and puts those that they induce; the ones under the same symbol come back."""
        sources = np.flatnonzero(at > 0)
        sources = sources[s_type[at[sources] - 1] == want]
        before = at[sources] - 1
        symbol = bucket[before]
        by, low = least.through(shared, sources, symbol)
        before, symbol, low = before[by], symbol[by], more(low)
        own = symbol == c
        if own.all():
            return before, low
        queue.put(before[~own], symbol[~own], low[~own])
        return before[own], low[own]

    def rounds(queue: Queue, least: _Least, c: int, want: bool) -> tuple[np.ndarray, np.ndarray]:
        at, shared = queue.take(c)
        if len(shared):
            shared = shared.copy()
            shared[0] = 0
        all_at, all_shared = [at], [shared]
        while len(at):
            at, shared = expand(queue, least, c, at, shared, want)
            all_at.append(at)
            all_shared.append(shared)
        return np.concatenate(all_at), np.concatenate(all_shared)

    least = _Least(TOP)
    for c in range(TOP):
        at, shared = rounds(up, least, c, False)
        if len(at):
            done.put(at, np.full(len(at), c), shared)
        lead, between = leads.take(c)
        if len(lead):
            between = between.copy()
            between[0] = min(int(run[at[-1]]), int(run[lead[0]]), cap) if len(at) else 0
            expand(up, least, c, lead, between, False)
    least = _Least(TOP)
    for c in range(TOP - 1, -1, -1):
        at, shared = rounds(down, least, c, True)  # downwards: each with the one above it
        lower, between = done.take(c)
        edge = min(int(run[at[-1]]), int(run[lower[-1]]), cap) if len(at) and len(lower) else 0
        if len(lower):
            # From the last one down, each shares with the one above it what that one shares with it.
            expand(down, least, c, lower[::-1], np.append(between[1:], np.uint8(edge))[::-1], True)
        if len(at):
            shared = np.append(shared[1:], np.uint8(edge))[::-1]
        yield np.concatenate((lower, at[::-1])), np.concatenate((between, shared))
    if any(q.file for q in (leads, up, down, done)):
        for q in (leads, up, down, done):
            if q.file:
                q.file.close()


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """The suffix order of a short-run string of names, by sorting pairs of ranks of doubled reach."""
    rank, n, step = names.astype(np.int64), len(names), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        new = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[sa] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return sa


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes from a and from b on are equal, up to a limit: eight at a time."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out, left, d = np.zeros(len(a), np.int64), np.flatnonzero(limit > 0), 0
    while len(left):
        x = words[a[left] + d].view("<u8")[:, 0] ^ words[b[left] + d].view("<u8")[:, 0]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
        out[left] = d + same
        d += 8
        left = left[(same == 8) & (limit[left] > d)]
    return np.minimum(out, limit)


def suffixes(text: np.ndarray, ends: np.ndarray, cap: int, held: int = HELD, folder: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``induce`` of a text of bytes. ``ends`` are separators' places, the last one the text's end: each is a symbol of its own, less than any byte."""
    n = len(text)
    bucket = text.astype(np.int16) + 1
    bucket[ends] = 0
    symbol = bucket.astype(np.int64) + len(ends)
    symbol[ends] = np.arange(len(ends))
    s_type, run = _runs(symbol)
    valleys = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    none = np.zeros(len(valleys), np.uint8)
    # First by their beginnings only: inducing from that puts their substrings in order.
    start = valleys[np.argsort(symbol[valleys], kind="stable")]
    is_valley = np.zeros(n, bool)
    is_valley[valleys] = True
    got = [at[is_valley[at]] for at, _ in induce(bucket, s_type, run, start, none, cap, held, folder)]
    # Separators are one bucket there; their order is that of their places.
    got = np.concatenate([ends[is_valley[ends]], *got[-2::-1]])
    size = np.full(n, 1, np.int64)
    size[valleys[:-1]] = np.diff(valleys) + 1
    same = size[got[1:]] == size[got[:-1]]
    left, d = np.flatnonzero(same), 0
    while len(left):
        a, b = got[left] + d, got[left + 1] + d
        equal = symbol[np.minimum(a, n - 1)] == symbol[np.minimum(b, n - 1)]
        same[left[~equal]] = False
        d += 1
        left = left[equal & (size[got[left]] > d)]
    name = np.empty(n, np.int64)
    name[got] = np.cumsum(np.concatenate(([0], ~same)))[: len(got)]
    names = name[valleys]
    del name, size, symbol
    if len(np.unique(names)) < len(valleys):
        got = valleys[_by_doubling(names)]
    after = np.diff(np.concatenate(([-1], ends)))
    left = (np.repeat(ends, after) - np.arange(n))[got]  # bytes before the next separator
    common = np.zeros(len(got), np.int64)
    common[1:] = _shared(text, got[1:], got[:-1], np.minimum(np.minimum(left[1:], left[:-1]), cap))
    yield from induce(bucket, s_type, run, got, common.astype(np.uint8), cap, held, folder)


def repeated_windows(parts: list[bytes], rank: np.ndarray, start: np.ndarray, length: int, held: int = HELD, folder: str | None = None) -> Iterator[tuple[int, int, int]]:
    """(segment, first window, windows) of runs of windows that an earlier segment has: earlier by (rank, start).

    Suffixes that share ``length`` bytes with the one before them begin with the
    same window; the common prefixes come with the order.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    of = np.repeat(np.arange(len(parts), dtype=np.int32), sizes + 1)
    late: list[np.ndarray] = []
    for order, common in suffixes(text, ends, length, held, folder):
        new = (common < length) | (text[order] == 0) & (ends[of[order]] == order)  # a separator begins no window
        if new.all():
            continue
        firsts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        at, group = order[several], group[several]
        seg = of[at]
        place = rank[seg] * (1 << 40) + start[seg] + at - (ends[seg] - sizes[seg])
        low = np.full(len(firsts), np.iinfo(np.int64).max)
        np.minimum.at(low, group, place)
        late.append(at[place > low[group]])
    found = np.sort(np.concatenate(late)) if late else np.empty(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1] + 1))) if len(found) else np.empty(0, np.int64)
    seg = of[found[new]] if len(found) else found
    offset = found[new] - (ends[seg] - sizes[seg]) if len(found) else found
    yield from zip(seg.tolist(), offset.tolist(), np.diff(np.append(new, len(found))).tolist(), strict=True)


def _fetched(docs: DataFrame, leads: DataFrame, length: int) -> DataFrame:
    """(h, id, th, s, part): the bytes of segments, from one join of the documents."""
    own = leads.groupBy("id", "th").agg(F.collect_list(F.struct("h", "p")).alias("xs"))
    joined = docs.join(own, ["id", "th"])

    def fetch(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for i, th, t, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), strict=True):
            for x in xs:
                s, w = x["p"] >> 8, x["p"] & 255
                for column, v in zip(out, (x["h"], i, th, s, t[s : s + w + length - 1]), strict=True):
                    column.append(v)
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["h", "id", "th", "s", "part"])

    return by_batch(joined, fetch, "h long, id long, th long, s long, part binary", rows=256)


#: Places of the anchor of a finer key, one level after the other.
SPANS = (9, 1)


def shard_repeats(docs: DataFrame, leads: DataFrame, length: int, *, shard: int = SHARD, held: int = HELD, crowd: int = CROWD, level: int = 0) -> DataFrame:
    """(id, th, p): windows of the leading segments that an earlier leading segment has.

    An anchor of more segments than a task should hold is split by the bytes
    around it (``finer_rows``): its segments are cut up, equal ones collapse,
    and the first ones of the finer keys are sorted like all others.
    """
    many = cut(leads.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("h"), "crowds")
    if level < len(SPANS) and not many.isEmpty():
        rest = shard_repeats(docs, leads.join(many, "h", "left_anti"), length, shard=shard, held=held, crowd=2**62)
        finer = cut(resolve(finer_rows(_fetched(docs, leads.join(many, "h"), length), length, SPANS[level])), "finer")
        own = shard_repeats(docs, finer.filter(~F.col("repeat")).select("h", "id", "th", "p"), length, shard=shard, held=held, crowd=crowd, level=len(SPANS) - 1 if level == 0 else len(SPANS))
        return rest.unionByName(finer.filter("repeat").select("id", "th", "p")).unionByName(own)
    parts = _fetched(docs, leads, length)
    dealt = parts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h").sortWithinPartitions("h", "id", "th", "s")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def work() -> pa.RecordBatch:
            # A document that is there twice brings its segments twice.
            kept = list(dict.fromkeys(rows))
            ids, ths, starts = (np.array([r[k] for r in kept], np.int64) for k in (1, 2, 3))
            by = np.lexsort((ths, ids))
            changed = np.concatenate(([0], (ids[by][1:] != ids[by][:-1]) | (ths[by][1:] != ths[by][:-1])))
            rank = np.empty(len(kept), np.int64)
            rank[by] = np.cumsum(changed)
            found = list(repeated_windows([r[4] for r in kept], rank, starts, length, held))
            seg = np.array([f[0] for f in found], np.int64)
            p = (starts[seg] + np.array([f[1] for f in found], np.int64)) * 256 + np.array([f[2] for f in found], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[seg]), pa.array(ths[seg]), pa.array(p)], ["id", "th", "p"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= shard and r[0] != rows[-1][0]:
                    yield work()
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4]) + 1
        if rows:
            yield work()
        release()

    return dealt.mapInArrow(run, PLACE)


def remove_repeats(df: DataFrame, *, text: str = "text", id_col: str = "doc_id", length: int = 100, shard: int = SHARD, held: int = HELD, crowd: int = CROWD) -> DataFrame:
    """``df`` with repeats cut out of ``text``, and n_bytes, n_removed and n_spans (maximal runs cut); columns of those names are replaced.

    The text that is left is bytes cut where a repeat begins or ends, which may
    be within a character: it is binary.
    """
    if length <= GRAM or length > 255:
        raise ValueError(f"length must be over {GRAM} and at most 255")
    docs = _documents(df, text, id_col)
    found = cut(resolve(segment_rows(docs, length)), "segments")
    more = cut(shard_repeats(docs, found.filter(~F.col("repeat")).select("h", "id", "th", "p"), length, shard=shard, held=held, crowd=crowd), "repeats")
    spans = found.filter("repeat").select("id", "th", "p").unionByName(more)
    own = spans.groupBy("id", "th").agg(F.collect_list("p").alias("__ps")).withColumnRenamed("id", "__id").withColumnRenamed("th", "__th")
    names = ("n_bytes", "n_removed", "n_spans")
    keep = without(df, *names)
    keyed = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("__id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__th"))
    joined = keyed.join(own, ["__id", "__th"], "left").select(*[F.col(f"`{c}`") for c in keep], "__ps")
    at = keep.index(text)

    def apply(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for t, ps in zip(utf8(b.column(at)), b.column(len(keep)), strict=True):
            spans, kept, end = 0, [], 0
            if ps.is_valid:
                x = np.sort(ps.values.to_numpy())
                for p in x.tolist():
                    a, z = p >> 8, (p >> 8) + (p & 255) + length - 1
                    if a > end or not spans:
                        kept.append(t[end:a])
                        spans += 1
                    end = max(end, z)
            kept.append(t[end:])
            left = b"".join(kept)
            for column, v in zip(out, (left, len(t), len(t) - len(left), spans), strict=True):
                column.append(v)
        columns = [pa.array(out[0], pa.binary()) if i == at else b.column(i) for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in out[1:])], [*keep, *names])

    schema = ", ".join(f"`{c}` {'binary' if c == text else df.schema[c].dataType.simpleString()}" for c in keep) + ", n_bytes long, n_removed long, n_spans long"
    return by_batch(joined, apply, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier, out of every document."""
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS MATERIALIZED (
  SELECT r, i, substr(h, 2 * i + 1, 200) AS s FROM d, range(0, n - 99) t(i)
), m AS (
  SELECT s, min(r * 1099511627776 + i) AS first FROM w GROUP BY s HAVING count(*) > 1
), late AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS last FROM w JOIN m USING (s) WHERE r * 1099511627776 + i > first
), run AS (
  SELECT r, min(i) AS a, max(i) + 100 AS z FROM (SELECT r, i, sum(CASE WHEN i > last + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM late) GROUP BY r, g
), piece AS (
  SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS p FROM run
), kept AS (
  SELECT r, sum(z - a)::BIGINT AS gone, count(*) AS spans, string_agg(substr(h, (2 * p + 1)::BIGINT, (2 * (a - p))::BIGINT), '' ORDER BY a) || any_value(h)[(2 * max(z) + 1)::BIGINT:] AS x FROM piece JOIN d USING (r) GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
