"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything here is DataFrame functions. A text is split at a pattern's matches;
the lengths of the pieces and of the matches give each match's place in code
points, and the piece before a match is its context.

The four base kinds (email, ip, card, phone) are kept whatever their score. The
other kinds (iban, ssn, tel) need a score of ``MIN_SCORE``: a checksum alone
suffices, a shape alone does not without a word of its context. Such a span is
left out where it overlaps one of a base kind.

A null text is the empty text. Ids are only carried: null and repeated ids and
repeated rows give a result for each row. Texts of any length are read whole; the
work is in proportion to a text and its matches, but for copies of one number for
each 64 matches, which grow with the square of those.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table, without

#: Code points before a match and behind it in which its context words count.
CONTEXT, AFTER = 48, 24
#: Earlier matches that can lie in a context: no match of any kind is shorter than 4.
LOOK_BACK = CONTEXT // 4
#: The least score of a span whose kind isn't a base kind.
MIN_SCORE = 0.7

SPANS = "array<struct<kind:string,start:int,end:int,score:double,text:string>>"


@dataclass(frozen=True)
class Kind:
    """A pattern, what must stand in a text for it to be tried, and the score's parts."""

    name: str
    pattern: str
    needs: str
    words: str
    shape: float
    base: bool = True


# Matches never backtrack into a run (possessive quantifiers), so long runs cost
# linear time and no stack. A match starts where a run of its first class does,
# or where the last match ended: nowhere earlier could one have begun.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write to|correo|courriel", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "9", r"\bip\b|address|host|server|login", 0.6),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12,}+", "9", "card|visa|mastercard|amex|credit|payment", 0.5),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", "phone|tel|call|mobile|fax|whatsapp", 0.7),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "9", "iban|account|bank|konto|cuenta|compte", 0.3, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "9", r"\bssn\b|social security|tax id", 0.4, False),
    Kind("tel", r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", "9", "phone|tel|call|mobile|fax|whatsapp", 0.4, False),
)

#: What a checksum adds to the score, and what a context word adds.
CHECKED, NEARBY = 0.4, 0.3


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass Luhn's check."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(1, 20):
        d = F.ascii(F.substring(padded, i, 1)) - 48
        total = total + (d if i % 2 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number of capitals and digits leaves 1 by 97, its first four moved to its end."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        digit = F.ascii(c) - 48
        return F.when(digit < 10, (rest * 10 + digit) % 97).otherwise((rest * 100 + digit - 7) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        account = F.replace(m, F.lit(" "), F.lit(""))
        return F.length(account).between(15, 34) & mod97(account)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _score(kind: Kind, near: Column) -> Column:
    fixed = kind.shape + (CHECKED if kind.name in ("card", "iban") else 0.0)
    return F.least(F.lit(1.0), F.lit(fixed) + F.when(F.lower(near).rlike(kind.words), NEARBY).otherwise(0.0))


#: Elements of a block of a running fold.
RUN = 64


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` folded over whole numbers, before each of them, from 0 on; ``values`` is a column that is there, as it is read for each block.

    A fold that appends copies what it has at each step. Here one runs within
    blocks of ``RUN`` values and one over the blocks, so the work of n values is
    in proportion to n, plus the square of n / RUN for the copies of the latter.
    """
    none = F.array().cast("array<int>")

    def walk(xs: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda b: F.slice(values, b * RUN + 1, RUN))
    firsts = walk(F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), step)), F.lit(0))
    many = F.flatten(F.zip_with(blocks, firsts, walk))
    return F.when(F.size(values) <= RUN, walk(values, F.lit(0))).otherwise(many)


def _near(pieces: Column, hits: Column, i: Column) -> Column:
    """The ``CONTEXT`` code points before match ``i``, through the matches before it, and the ``AFTER`` ones behind."""
    first = F.greatest(F.lit(0), i - LOOK_BACK)
    before = F.array_join(F.transform(F.sequence(first, i), lambda j: F.concat(F.when(j > first, hits[j - 1]).otherwise(""), F.right(pieces[j], F.lit(CONTEXT)))), "")
    return F.concat(F.right(before, F.lit(CONTEXT)), F.lit(" | "), F.left(pieces[i + 1], F.lit(AFTER)))


def _lengths(pieces: Column, hits: Column) -> Column:
    every = F.sequence(F.lit(0), F.size(hits) - 1)
    return F.when(F.size(hits) > 0, F.transform(every, lambda i: F.char_length(pieces[i]) + F.char_length(hits[i]))).otherwise(F.array().cast("array<int>"))


def _found(kind: Kind, pieces: Column, hits: Column, lengths: Column) -> Column:
    """Confirmed spans of one kind, in the order of their starts."""

    def span(begin: Column, i: Column) -> Column:
        start = begin + F.char_length(pieces[i])
        parts = (F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.char_length(hits[i])).alias("end"), _score(kind, _near(pieces, hits, i)).alias("score"), hits[i].alias("text"))
        return F.when(_valid(kind.name, hits[i]), F.struct(*parts))

    every = F.sequence(F.lit(0), F.size(hits) - 1)
    good = F.filter(F.zip_with(_running(lengths, lambda at, n: at + n), every, span), lambda s: s.isNotNull() if kind.base else s.isNotNull() & (s["score"] >= MIN_SCORE))
    return F.when(F.size(hits) > 0, good.cast(SPANS)).otherwise(F.array().cast(SPANS))


#: More than any place in a text.
FAR = 2**31 - 1


def _apart(df: DataFrame, keep: list[Column]) -> DataFrame:
    """Base spans, and others that overlap none of them: in the order of all starts no base span before one reaches into it, and none behind begins in it."""
    some = F.size("__more") > 0
    every = F.concat(F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(-1).alias("i"))), F.transform("__more", lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"))))
    ordered = df.select("*", F.when(some, F.array_sort(every)).alias("__all"))
    ends = F.transform("__all", lambda s: F.when(s["i"] < 0, s["end"]).otherwise(0))
    begins = F.transform(F.reverse("__all"), lambda s: F.when(s["i"] < 0, F.lit(FAR) - s["start"]).otherwise(0))
    folded = ordered.select("*", ends.alias("__ends"), begins.alias("__begins"))
    last = _running(F.col("__ends"), _most)
    following = F.reverse(_running(F.col("__begins"), _most))
    walled = folded.select("*", F.when(some, F.arrays_zip(F.col("__all").alias("s"), last.alias("last"), following.alias("next"))).alias("__walled"))
    free = F.filter("__walled", lambda x: (x["s"]["i"] >= 0) & (x["last"] <= x["s"]["start"]) & (F.lit(FAR) - x["next"] >= x["s"]["end"]))
    kept = F.transform(F.array_sort(F.transform(free, lambda x: x["s"]["i"])), lambda i: F.col("__more")[i])
    return walled.select(*keep, F.when(some, F.concat("__base", kept)).otherwise(F.col("__base")).alias("pii"))


def find_pii(df: DataFrame, *, text: str = "text") -> DataFrame:
    """``df`` with the column ``pii``: its spans (kind, start, end, score, text), kinds in their order, then starts.

    A column named ``pii`` is replaced. Places are in code points, ends are exclusive.
    """
    keep = [F.col(f"`{c}`") for c in without(df, "pii")]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digits = whole.rlike("[0-9]")
    tried = {"@": F.when(F.contains(whole, F.lit("@")), whole), "+": F.when(F.contains(whole, F.lit("+")), whole), "9": F.when(digits, whole)}
    names = {"@": "__at", "+": "__plus", "9": "__digit"}
    step1 = df.select(*keep, *[F.coalesce(c, F.lit("")).alias(names[k]) for k, c in tried.items()])
    step2 = step1.select(
        *keep,
        *[F.regexp_extract_all(names[k.needs], F.lit(k.pattern), 0).alias(f"__h_{k.name}") for k in KINDS],
        *[F.split(names[k.needs], k.pattern, -1).alias(f"__p_{k.name}") for k in KINDS],
    )
    step3 = step2.select("*", *[_lengths(F.col(f"__p_{k.name}"), F.col(f"__h_{k.name}")).alias(f"__n_{k.name}") for k in KINDS])
    step4 = step3.select(*keep, *[_found(k, *[F.col(f"__{x}_{k.name}") for x in "phn"]).alias(f"__s_{k.name}") for k in KINDS])
    base = F.concat(*[F.col(f"__s_{k.name}") for k in KINDS if k.base])
    more = F.concat(*[F.col(f"__s_{k.name}") for k in KINDS if not k.base])
    return _apart(step4.select(*keep, base.alias("__base"), more.alias("__more")), keep)


#: Code points of a block of a text that is cut.
BLOCK = 4096


def redact(df: DataFrame, *, text: str = "text") -> DataFrame:
    """``df`` with each span of ``pii`` in its text replaced by its kind in angle brackets; overlapping spans give one gap.

    Reaching into a text takes time by the distance, so what stays between two
    spans is cut from the blocks that it lies in.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind"))))
    names = ("__spans", "__blocks", "__length", "__ends")
    ready = df.select("*", ordered.alias(names[0]), F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{BLOCK}}}"), 0).alias(names[1]), F.char_length(whole).alias(names[2]))
    ready = ready.select("*", F.transform(names[0], lambda s: s["end"]).alias(names[3]))
    spans, blocks, length, ends = map(F.col, names)

    def stretch(a: Column, z: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        held = F.array_join(F.slice(blocks, first + 1, F.floor((z - 1) / BLOCK).cast("int") - first + 1), "")
        return F.when(z > a, F.substr(held, a - first * BLOCK + 1, z - a)).otherwise("")

    reached = _running(ends, _most)
    cut = F.zip_with(reached, spans, lambda at, s: F.when(s["start"] < at, "").otherwise(F.concat(stretch(at, s["start"]), F.lit("<"), s["kind"], F.lit(">"))))
    end = F.aggregate(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
    done = F.concat(F.array_join(cut, ""), stretch(end, length))
    return ready.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(f"`{text}`"))).drop(*names)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, and their scores in the same order; the hash is over the base kinds."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *[_count(n).alias(f"n_{n}") for n in base],
        F.sha2(_joined(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )
