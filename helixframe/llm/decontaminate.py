"""Benchmark decontamination through an FM-index of each training shard.

Texts become streams of word ids. Words that no benchmark item has cannot be
part of an occurrence, so a shard's stream keeps only the runs of benchmark
words that are long enough to hold a window. Over that stream each shard builds
a suffix order, its Burrows-Wheeler transform in a wavelet matrix, and the
positions of every 16th suffix. All windows are searched backwards together; the
occurrences are located by walking to sampled suffixes, and their spans merged.

The benchmark is a query set that is stated beforehand: it goes to the
executors in blocks of bounded size, ``block_chars`` characters each, however
large it is, and the blocks' findings are put together by document.

Null texts have no words, nor have null or empty items any window. Repeated
items count by their ids. Each row of the documents gives a row; repeated rows
give repeated results. Null item ids are left out of the list of ids. A text of
any length is one part of a shard's stream, whole. Other columns stay as they
are, but for those that have the names of the new ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import by_batch, table, utf8, without

#: Bytes to word bytes: A-Z in lower case, anything but letters, digits and what isn't ASCII to a space.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Ids of a shard's stream at which its index is built.
SHARD = 1 << 20
#: Every such text position's place in the suffix order is kept.
SAMPLED = 16
#: Occurrences that are located at a time.
LOCATED = 1 << 16


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


#: By length: the distinct windows, and the items that have each (item numbers of window q from offsets[q] to offsets[q + 1]).
Windows = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def item_windows(items: list[list[bytes]], size: int) -> tuple[dict[bytes, int], Windows]:
    """Word ids from 1, and the windows by length. An item of fewer words is one window. Windows are rows of numbers of four bytes each, so a block takes some times its characters."""
    ids: dict[bytes, int] = {}
    rows: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, item in enumerate(items):
        row = np.array([ids.setdefault(w, len(ids) + 1) for w in item], np.int32)
        n = min(size, len(row))
        if n:
            rows.setdefault(n, []).append((k, np.lib.stride_tricks.sliding_window_view(row, n)))
    found: Windows = {}
    for n, parts in rows.items():
        own = np.repeat(np.array([k for k, _ in parts], np.int32), [len(w) for _, w in parts])
        table = np.concatenate([w for _, w in parts])
        order = np.lexsort((own, *table.T[::-1]))
        table, own = table[order], own[order]
        new = np.concatenate(([True], (table[1:] != table[:-1]).any(1)))
        once = new | np.concatenate(([True], own[1:] != own[:-1]))
        which = np.cumsum(new) - 1
        offsets = np.concatenate(([0], np.cumsum(np.bincount(which[once]))))
        found[n] = (table[new], offsets, own[once])
    return ids, found


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many queries at once."""

    def __init__(self, seq: np.ndarray, top: int):
        self.n, self.levels = len(seq), []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (seq >> shift) & 1
            ones = np.concatenate(([0], np.cumsum(bit))).astype(np.int32)
            self.levels.append((shift, ones, self.n - int(ones[-1])))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end."""
        lo, hi = np.zeros_like(ends), ends.copy()
        for shift, ones, zeros in self.levels:
            one = (symbols >> shift) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for _, ones, zeros in self.levels:
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Backward search over a stream of ids from 1; 0 ends the stream and parts its runs."""

    def __init__(self, stream: np.ndarray):
        seq = np.append(stream.astype(np.int64), 0)
        n = len(seq)
        # Each end of a run sorts by its place, so no comparison passes one.
        order = np.where(seq == 0, -np.arange(n)[::-1] - 1, seq)
        rank = np.unique(order, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            sa = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[sa] = np.concatenate(([0], np.cumsum(key[sa][1:] != key[sa][:-1])))
            rank, step = new, step * 2
            if rank[sa[-1]] == n - 1 or step >= n:
                break
        self.n, self.top = n, int(seq.max())
        bwt = seq[sa - 1]
        self.bwt = WaveletMatrix(bwt, self.top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=self.top + 2))))
        # Ends of runs are ordered by place, not by what follows, so no step may lead to one: each run's first position is kept too.
        kept = (sa % SAMPLED == 0) | (bwt == 0)
        self.kept, self.where = np.concatenate(([0], np.cumsum(kept))), sa[kept]
        self.is_kept = kept

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for c in patterns.T[::-1]:
            known = (c <= self.top) & (lo < hi)
            c = np.where(known, c, 1)
            lo, hi = (self.first[c] + self.bwt.rank(c, x) for x in (lo, hi))
            hi = np.where(known, hi, lo)
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out, steps, left = np.empty(len(at), np.int64), 0, np.arange(len(at))
        at = at.copy()
        while len(left):
            here = self.is_kept[at]
            out[left[here]] = self.where[self.kept[at[here]]] + steps
            left, at = left[~here], at[~here]
            c = self.bwt.access(at)
            at = self.first[c] + self.bwt.rank(c, at)
            steps += 1
        return out


def _hits(texts: list[bytes], ids: dict[bytes, int], windows: Windows) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
    """(words, merged spans of hit words, items) of each text, shard by shard."""
    least = min(windows, default=0)
    get = ids.get
    held: list[tuple[int, list]] = []
    parts: list[np.ndarray] = []
    size = 0

    def search() -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        spans: list[list[tuple[int, int]]] = [[] for _ in held]
        items: list[set[int]] = [set() for _ in held]
        if size:
            index = FMIndex(np.concatenate(parts))
            starts = np.array([s for _, runs in held for s, _, _ in runs], np.int64)
            back = [(k, first - s) for k, (_, runs) in enumerate(held) for s, first, _ in runs]
            for n, (patterns, offsets, owners) in windows.items():
                lo, hi = index.search(patterns)
                before = np.concatenate(([0], np.cumsum(hi - lo)))
                for a in range(0, int(before[-1]), LOCATED):
                    flat = np.arange(a, min(a + LOCATED, int(before[-1])))
                    p = np.searchsorted(before, flat, "right") - 1
                    at = index.locate(lo[p] + flat - before[p])
                    for q, x, run in zip(p.tolist(), at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist(), strict=True):
                        k, shift = back[run]
                        spans[k].append((x + shift, x + shift + n))
                        items[k].update(owners[offsets[q] : offsets[q + 1]].tolist())
        for (n, _), s, i in zip(held, spans, items, strict=True):
            merged: list[list[int]] = []
            for a, b in sorted(s):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            yield n, [(a, b) for a, b in merged], i

    for t in texts:
        w = words(t)
        runs = []
        if least:
            row = np.fromiter(map(get, w, repeat(0)), np.int32, len(w))
            edge = np.flatnonzero(np.diff(np.concatenate(([False], row > 0, [False])).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= least:
                    runs.append((size, a, b))
                    parts.append(np.append(row[a:b], np.int32(0)))
                    size += b - a + 1
        held.append((len(w), runs))
        if size >= SHARD:
            yield from search()
            held, parts, size = [], [], 0
    yield from search()


_ANY_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_out(text: bytes, spans: list[list[int]] | list[tuple[int, int]]) -> bytes:
    """The text without the words of its spans."""
    places = [m.span() for m in _ANY_WORD.finditer(text)]
    kept, end = [], 0
    for a, z in spans:
        kept.append(text[end : places[a][0]])
        end = places[z - 1][1]
    return b"".join([*kept, text[end:]])


def _blocks(benchmark: DataFrame, item_text: str, block_chars: int) -> int:
    return max(1, -(-(benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0) // block_chars))


def find_benchmark(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_chars: int = 8_000_000, remove: bool = False) -> DataFrame:
    """``df`` with n_words, spans (array of [start, end) in words, merged) and items (sorted ids as strings); columns of those names are replaced.

    With a benchmark of more than one block the texts are read once for each,
    and spans from different blocks merged within each row. ``remove`` cuts the
    spans' words out of the texts, from each span's first word to its last, in
    the last of these passes; clean texts stay as they are.
    """
    names = ("n_words", "spans", "items")
    keep = without(df, *names)
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    blocks = _blocks(benchmark, item_text, block_chars)
    numbered = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"), F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)).alias("b"))
    at = keep.index(text)
    out = df.withColumn("n_words", F.lit(0).cast("long")).withColumn("spans", F.array().cast("array<struct<start:long,end:long>>")).withColumn("items", F.array().cast("array<string>"))
    schema = out.schema
    for k in range(blocks):
        rows = numbered.filter(F.col("b") == k).collect()  # a block: bounded by block_chars
        items = [words((r.t or "").encode()) for r in rows]
        ids, windows = item_windows(items, size)
        shared = df.sparkSession.sparkContext.broadcast((ids, windows, [r.i for r in rows]))

        def mark(b: pa.RecordBatch, shared=shared, last=remove and k == blocks - 1) -> pa.RecordBatch:
            ids, windows, names_of = shared.value
            n, spans, items = [], [], []
            whole, left = utf8(b.column(at)), b.column(at).to_pylist() if last else []
            before = b.column(len(keep) + 1).to_pylist(), b.column(len(keep) + 2).to_pylist()
            for (count, found, own), old, seen in zip(_hits(whole, ids, windows), *before, strict=True):
                if old:
                    both: list[list[int]] = []
                    for a, z in sorted([*found, *((x["start"], x["end"]) for x in old)]):
                        if both and a <= both[-1][1]:
                            both[-1][1] = max(z, both[-1][1])
                        else:
                            both.append([a, z])
                    found = both
                if last and found:
                    left[len(n)] = cut_out(whole[len(n)], found).decode()
                n.append(count)
                spans.append([{"start": a, "end": z} for a, z in found])
                items.append(sorted({names_of[i] for i in own if names_of[i] is not None} | set(seen)))
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
            columns = [pa.array(left, pa.string()) if last and i == at else c for i, c in enumerate(b.columns[: len(keep)])]
            columns += [pa.array(n, pa.int64()), pa.array(spans, kinds[0]), pa.array(items, kinds[1])]
            return pa.RecordBatch.from_arrays(columns, [*keep, *names])

        out = by_batch(out, mark, schema, rows=8192)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words of the whole benchmark in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"), size=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP6_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, {_WORDS_SQL} AS ws FROM documents
), b AS (
  SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark
), item AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0), range(1, len(ws) - n + 2) t(i)
), win AS (
  SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
  FROM d, (SELECT DISTINCT n FROM item), range(1, len(ws) - n + 2) t(i)
), hit AS MATERIALIZED (
  SELECT win.doc_id, win.i, win.n, item.item_id FROM win JOIN item USING (n, w)
), place AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, range(i, i + n) t(p) GROUP BY doc_id
), own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
       sha256(coalesce(o.xs, '')) AS items_sha256, p.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN place p USING (doc_id) LEFT JOIN own o USING (doc_id)
"""
