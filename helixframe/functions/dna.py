"""DNA text and orientation algebra as Column expressions: generated code or built-ins, but for distances, which are taken of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.ship import ship

#: Letters of the packed form, fixed values: each base, then the pairs that begin with it, take the next letter from A on.
PACKED = {code: chr(65 + i) for i, code in enumerate(x + y for x in "ACGT" for y in ["", *"ACGT"])}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rc(seq: Column | str) -> Column:
    """Reverse complement; characters other than ACGT are dropped."""
    return F.reverse(F.translate(F.regexp_replace(_c(seq), "[^ACGT]", ""), "ACGT", "TGCA"))


def rc_strict(seq: Column | str) -> Column:
    """Reverse complement of text known to be ACGT only."""
    return F.reverse(F.translate(_c(seq), "ACGT", "TGCA"))


def canonical(seq: Column | str) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(_c(seq), rc_strict(seq))


def oriented(seq: Column | str, direction: Column | str) -> Column:
    return F.when(_c(direction) == "f", _c(seq)).otherwise(rc_strict(seq))


def flip_dir(d: Column | str) -> Column:
    return F.translate(_c(d), "fr", "rf")


def flip_link(e: Column | str) -> Column:
    """ff to rr, rr to ff; fr and rf stay."""
    return F.reverse(flip_dir(e))


def is_dna(seq: Column | str) -> Column:
    return _c(seq).rlike("^[ACGT]*$")


def homopolymer(kmer: Column | str) -> Column:
    """All A or all T."""
    return _c(kmer).rlike("^(?:A*|T*)$")


def dna_pack(seq: Column | str) -> Column:
    """The interchange form: four bases give two letters; an odd base gives one of its own. Pairs with another letter are left out."""
    s = _c(seq)
    # Pairs are told by a mark behind each, so that a replacement meets no other two letters; letters of the result have none.
    pairs = F.regexp_replace(s, "(?s)(..)", "$1 ")
    odd = F.length(s) % 2 == 1
    x = F.when(odd, F.left(pairs, F.length(pairs) - 1)).otherwise(pairs)
    for base, code in PACKED.items():
        if len(base) == 2:
            x = F.replace(x, F.lit(base + " "), F.lit(code))
    x = F.when(F.contains(x, F.lit(" ")), F.regexp_replace(x, "(?s).. ", "")).otherwise(x)
    last = F.right(s, F.lit(1))
    tail = F.coalesce(*[F.when(odd & (last == base), F.lit(code)) for base, code in PACKED.items() if len(base) == 1], F.lit(""))
    return F.concat(x, tail)


def dna_unpack(packed: Column | str) -> Column:
    x = F.regexp_replace(_c(packed), "[^A-T]", "")
    # Letters that are bases as well step aside while the others become bases.
    for code in "CGT":
        x = F.replace(x, F.lit(code), F.lit(code.lower()))
    for base, code in PACKED.items():
        x = F.replace(x, F.lit(code.lower() if code in "CGT" else code), F.lit(base))
    return x


def packed_length(n: Column) -> Column:
    """Letters of the packed form of n bases: one for each begun pair."""
    return F.floor((n + 1) / 2).cast("int")


def str_concat(a: Column | str, b: Column | str, overlap: Column | str) -> Column:
    """``a`` followed by what ``b`` has beyond the overlap."""
    return F.concat(_c(a), F.substr(_c(b), _c(overlap) + 1))


def mate_name(read_id: Column | str) -> Column:
    """x_1 and x_2 are mates; others have none."""
    r = _c(read_id)
    return F.when(r.endswith("_1"), F.regexp_replace(r, "_1$", "_2")).when(r.endswith("_2"), F.regexp_replace(r, "_2$", "_1"))


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' code points one after another, where each text begins, and its length; of a null none."""
    whole = "".join(texts.fill_null("").to_pylist())
    size = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    return points, np.cumsum(size) - size, size


def _whole(numbers: np.ndarray, a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(numbers, pa.int32(), mask=(a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False)))


def _differing(a: pa.Array, b: pa.Array) -> pa.Array:
    x, x_at, x_size = _letters(a)
    y, y_at, y_size = _letters(b)
    size = np.minimum(x_size, y_size)
    ends = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(ends[-1])
    differ = x[place + np.repeat(x_at - ends[:-1], size)] != y[place + np.repeat(y_at - ends[:-1], size)]
    seen = np.concatenate(([0], np.cumsum(differ)))
    return _whole(seen[ends[1:]] - seen[ends[:-1]], a, b)


def _edits(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distances. Where the lesser text has up to 64 letters a column of the table is two words of bits, for all rows at once; others row by row of the table."""
    x, x_at, x_size = _letters(a)
    y, y_at, y_size = _letters(b)
    swap = x_size > y_size
    letters, codes = np.unique(np.concatenate((x, y)), return_inverse=True)
    n, m = np.where(swap, x_size, y_size), np.where(swap, y_size, x_size)
    n_at, m_at = np.where(swap, x_at, y_at + len(x)), np.where(swap, y_at + len(x), x_at)
    out = n.copy()  # of an empty text
    rows = np.flatnonzero((m > 0) & (m <= 64))
    one = np.uint64(1)
    if len(rows):
        k, at, long, long_at = m[rows], m_at[rows], n[rows], n_at[rows]
        equal = np.zeros((len(letters), len(rows)), np.uint64)
        every = np.arange(len(rows))
        for i in range(int(k.max())):
            own = every[i < k]
            equal[codes[at[own] + i], own] |= one << np.uint64(i)
        top = one << (k - 1).astype(np.uint64)
        plus, minus, score = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), np.uint64), k.copy()
        for j in range(int(long.max())):
            inside = j < long
            eq = equal[codes[long_at + np.minimum(j, long - 1)], every]
            v = eq | minus
            h = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(h | plus), plus & h
            score += inside & (up & top > 0)
            score -= inside & (down & top > 0)
            up, down = up << one | one, down << one
            plus, minus = down | ~(v | up), up & v
        out[rows] = score
    for r in np.flatnonzero(m > 64).tolist():
        p, t = codes[m_at[r] : m_at[r] + m[r]], codes[n_at[r] : n_at[r] + n[r]]
        places = np.arange(len(p) + 1)
        row = places.copy()
        for c in t.tolist():
            new = np.minimum(row + 1, np.append(row[0] + 1, row[:-1] + (p != c)))
            row = np.minimum.accumulate(new - places) + places
        out[r] = row[-1]
    return _whole(out, a, b)


def _batched(f: Callable[[pa.Array, pa.Array], pa.Array], a: Column | str, b: Column | str, kind: str = "int") -> Column:
    """``f`` over Arrow batches of two texts, a value for each row."""
    ship(SparkSession.active())

    def batched(x: pa.Array, y: pa.Array) -> pa.Array:
        return f(x, y)

    return F.arrow_udf(batched, kind)(_c(a), _c(b))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places that differ in the common prefix."""
    return _batched(_differing, a, b)


def edits(a: Column | str, b: Column | str) -> Column:
    """Edit distance, as ``levenshtein`` has it, for very many short texts."""
    return _batched(_edits, a, b)


def hamming_ratio(a: Column | str, b: Column | str) -> Column:
    """The share of places that differ in the common prefix; null where that is empty."""
    n = F.least(F.length(_c(a)), F.length(_c(b)))
    return F.when(n > 0, hamming(F.left(_c(a), n), F.left(_c(b), n)) / n)


def _blocks_alike(x: str, y: str) -> bool:
    n = min(len(x), len(y))
    step = n // 100
    return sum(x[i * step : (i + 1) * step] == y[i * step : (i + 1) * step] for i in range(100)) >= 90


def similar(a: Column | str, b: Column | str, rate: float = 0.1) -> Column:
    """Edit distance below a share of the shorter length, both cut to it; over 1000 bases 90 equal blocks of 100 instead; null where that length is 0."""

    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        n = pc.min_element_wise(pc.utf8_length(x), pc.utf8_length(y), skip_nulls=False).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros(len(n), bool)
        short = np.flatnonzero((n > 0) & (n <= 1000))
        if len(short):
            p, q = ([t[:k] for t, k in zip(c.take(pa.array(short)).to_pylist(), n[short].tolist(), strict=True)] for c in (x, y))
            out[short] = _edits(pa.array(p, pa.string()), pa.array(q, pa.string())).to_numpy(zero_copy_only=False) / n[short] < rate
        for i in np.flatnonzero(n > 1000).tolist():
            out[i] = _blocks_alike(x[i].as_py(), y[i].as_py())
        return pa.array(out, pa.bool_(), mask=n == 0)

    return _batched(alike, a, b, "boolean")


def kmers(seq: Column | str, k: int, *, last: bool = False) -> Column:
    """(pos, kmer) of each window, without the last window unless asked for; empty if there is none."""
    s = _c(seq)
    n = F.length(s) - k + (1 if last else 0)
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("pos"), F.substr(s, i + 1, F.lit(k)).alias("kmer")))
    return F.when(n > 0, made)
