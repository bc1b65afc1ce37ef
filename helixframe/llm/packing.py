"""Bounded-space online packing of tokenised documents into sequences of one length.

A partition's documents come one after the other. Each is cut into pieces of
at most a window; a full piece is a sequence of its own. Any other goes to the
open window that it fills best. If none has room, the fullest window is filled
with the head of the piece, where that is worth a cut, and emitted; what is
left finds a place anew. A fixed number of windows is open at a time. What the
partitions' windows hold at the end is merged: the leftovers of many
partitions are packed once more by the same rules.

A null or empty text gives its end token alone. Each row is a document of its
own: repeated rows and ids are packed each for itself, null ids too. A text of
any length is packed whole, in as many pieces as it needs. Other columns than
id and text are left out: a row of the result is a piece, and the id leads back
to them; whatever they are named, they clash with none. A sequence number is
made of the merge round, the partition and a count, so a task that
runs again makes the same.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import once_in_worker, release, small_batches, table, texts
from helixframe.plans.scratch import cut

#: Bytes of words and ids, each with what Python adds to it, that a worker keeps; beyond it starts anew, so memory is bounded.
KNOWN_BYTES = 64 << 20
#: What a kept word takes beside its letters and its ids: two objects' heads and its place in the table.
ENTRY = 200
#: Bytes of new words that are encoded in one go: the tokenizer's own form of them takes a hundred times as much.
LEARN_BYTES = 128 << 10
#: Bytes of texts that are split into words at a time, and rows of them at most.
GROUP_BYTES, GROUP_ROWS = 512 << 10, 256
#: Words of one text that are looked up at a time.
GROUP_WORDS = 64 << 10
#: How the tokenizer cuts a word: contractions, runs of letters, single digits, runs of other marks.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts with these aren't split at white space first: separators that only Python takes as white space, and special tokens.
WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Below it no letter's case or normal form depends on its neighbours.
ALONE = 0x250

PIECES = "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _by_words(text: str) -> bool:
    if any(x in text for x in WHOLE):
        return False
    return text.isascii() or int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max()) < ALONE


def word_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of texts by a tokenizer of words with end marks, whose tokens never span white space.

    A word's ids are worked out once and kept. New words are cut where the
    tokenizer would cut them, and the parts that are new as well are encoded in
    slices of ``LEARN_BYTES``, set apart by spaces: each part's ids end with the
    first one that is marked as a word's end. A text that could depend on more
    than its words goes to the tokenizer whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    plain = Tokenizer.from_file(path)
    vocabulary = plain.get_vocab()
    # Parts come in their normal form and set apart by spaces: no more is left to do before the merges.
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    cut_word = regex.compile(CUTS).findall
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    del vocabulary
    known: dict[str, bytes] = {}
    held = 0
    whole: list[Tokenizer] = []

    def parts_of(w: str) -> list[str]:
        if w[-1] in ",." and w[:-1].isalpha():
            return [w[:-1], w[-1]]
        return cut_word(w)

    def keep(words: list[str], ids: list[bytes]) -> None:
        nonlocal held
        known.update(zip(words, ids, strict=True))
        held += sum(map(len, words)) + sum(map(len, ids)) + ENTRY * len(words)

    def ask(new: list[str]) -> None:
        lines = [" ".join(new[i : i + 200]) for i in range(0, len(new), 200)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in plain.encode_batch_fast(lines, add_special_tokens=False)])
        stop = np.flatnonzero(ends[ids]) + 1
        if len(stop) != len(new):
            raise ValueError("the tokenizer's words don't end where its white space is")
        raw = ids.tobytes()
        stop = (4 * stop).tolist()
        keep(new, [raw[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)])

    def learn(words: set[str]) -> None:
        """``words``: none of them known. Those of letters only are parts themselves, and most."""
        new = list(filter(str.isalpha, words))
        cut_up = {w: parts_of(w) for w in words if not w.isalpha()}
        more = {p for parts in cut_up.values() for p in parts}
        new += [p for p in more if p not in known and not (p in words and p.isalpha())]
        size, first = 0, 0
        for i, p in enumerate(new):
            size += len(p)
            if size >= LEARN_BYTES:
                ask(new[first : i + 1])
                size, first = 0, i + 1
        if first < len(new):
            ask(new[first:])
        several = [(w, parts) for w, parts in cut_up.items() if len(parts) > 1]
        keep([w for w, _ in several], [b"".join(map(known.__getitem__, parts)) for _, parts in several])

    def look_up(group: list[list[str]]) -> None:
        """Every word of the group is known then."""
        nonlocal held
        words = set().union(*group)
        new = words.difference(known)
        if new and held > KNOWN_BYTES:
            known.clear()
            held, new = 0, words
        if new:
            learn(new)

    def encode(batch: list[str]) -> list[np.ndarray]:
        split = [t.lower().split() if _by_words(t) else None for t in batch]
        short = [s for s in split if s and len(s) <= GROUP_WORDS]
        if short:
            look_up(short)
        done = [None if s is None or len(s) > GROUP_WORDS else np.frombuffer(b"".join(map(known.__getitem__, s)), "<u4") for s in split]
        for i, (t, words) in enumerate(zip(batch, split, strict=True)):
            if words is None:
                if not whole:
                    whole.append(Tokenizer.from_file(path))
                done[i] = np.array(whole[0].encode(t, add_special_tokens=False).ids, "<u4")
            elif done[i] is None:
                parts = []
                for a in range(0, len(words), GROUP_WORDS):
                    look_up([words[a : a + GROUP_WORDS]])
                    parts.append(b"".join(map(known.__getitem__, words[a : a + GROUP_WORDS])))
                done[i] = np.frombuffer(b"".join(parts), "<u4")
        return done

    return encode


def groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of up to ``GROUP_ROWS`` rows and about ``GROUP_BYTES`` bytes; one text at least."""
    size = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > first and (held + n > GROUP_BYTES or i - first == GROUP_ROWS):
            yield first, texts(column.slice(first, i - first))
            first, held = i, 0
        held += n
    if first < len(column):
        yield first, texts(column.slice(first))


class Packer:
    """One partition's open windows. ``emit`` gets (window number, pieces) of each sequence that is done."""

    def __init__(self, size: int, windows: int, min_cut: int, emit: Callable[[list], None]):
        self.size, self.windows, self.min_cut, self.emit = size, windows, min_cut, emit
        self.open: list[list] = []  # [tokens held, pieces]

    def add(self, doc: int | None, start: int, ids: np.ndarray, tokens: int) -> None:
        while len(ids) >= self.size:
            self.emit([(doc, start, ids[: self.size], tokens)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            fits = [w for w in self.open if w[0] + len(ids) <= self.size]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
                self.open.remove(best)
                room = self.size - best[0]
                if room >= self.min_cut:
                    best[1].append((doc, start, ids[:room], tokens))
                    start, ids = start + room, ids[room:]
                self.emit(best[1])
                continue
            best[0] += len(ids)
            best[1].append((doc, start, ids, tokens))
            if best[0] == self.size:
                self.open.remove(best)
                self.emit(best[1])
            return


def _runner(size: int, windows: int, min_cut: int, round_no: int, last: bool, keep_ids: bool, path: str | None, end_id: int) -> Callable:
    """The function for mapInArrow. Pieces that stay in open windows go out without a sequence, with their ids, unless this is the last round."""

    def rows(parts: list, sequence: int | None) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, tokens in parts:
            raw = ids.tobytes()
            yield doc, start, len(ids), zlib.crc32(raw), tokens, sequence, None if sequence is None else offset, raw if keep_ids or sequence is None else None
            offset += len(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        first = (round_no << 58) + (TaskContext.get().partitionId() << 34)
        count = 0

        def emit(parts: list) -> None:
            nonlocal count
            done.extend(rows(parts, first + count))
            count += 1

        packer = Packer(size, windows, min_cut, emit)
        encode = once_in_worker(f"encoder {path}", lambda: word_encoder(path)) if path else None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            if encode:
                for at, group in groups(b.column(1)):
                    for doc, ids in zip(b.column(0).slice(at, len(group)).to_pylist(), encode(group), strict=True):
                        packer.add(doc, 0, np.append(ids, np.uint32(end_id)), len(ids) + 1)
                    if done:
                        yield flush()
            else:
                for doc, start, tokens, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    packer.add(doc, start, np.frombuffer(raw, "<u4"), tokens)
            if done:
                yield flush()
        for _, parts in sorted(packer.open, key=lambda w: -w[0]):
            if last:
                emit(parts)
            else:
                done.extend(rows(parts, None))
        if done:
            yield flush()
        release()

    return run


def pack(df: DataFrame, tokenizer_path: str, *, text: str = "text", id_col: str = "doc_id", size: int = 2048, windows: int = 64, min_cut: int = 16, end_id: int = 1, keep_ids: bool = True, merge: int = 16) -> DataFrame:
    """A row for each piece: doc, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if kept, ids (little-endian 32 bits each).

    ``merge`` partitions' leftovers are packed together in the last round. The
    first round's rows are written to the shared folder, as both the finished
    pieces and the leftovers are read from them. ``tokenizer_path`` must exist
    on the workers.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    first = cut(source.mapInArrow(_runner(size, windows, min_cut, 0, False, keep_ids, tokenizer_path, end_id), PIECES), "packed")
    left = first.filter("sequence_id IS NULL").select("doc", "start", "doc_tokens", "ids")
    parts = max(1, -(-source.rdd.getNumPartitions() // merge))
    left = left.repartition(parts, F.xxhash64("doc", "start")).sortWithinPartitions("doc", "start")
    rest = left.mapInArrow(_runner(size, windows, min_cut, 1, True, keep_ids, None, end_id), PIECES)
    return first.filter("sequence_id IS NOT NULL").unionByName(rest)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens of a public word BPE vocabulary."""
    import public_tokenizers

    found = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return found.select(F.col("doc").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
