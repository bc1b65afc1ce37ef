"""Records are put into shards of near equal bytes, in the order of a key, by sampled splitters.

Splitters are quantiles of a sample in which a record is drawn as often as its
bytes ask for. They cut the order into many more ranges than there are shards.
Ranges are counted exactly, and one that is overfull, in bytes or in records,
is subdivided by a new sample of its own records, until none is. Running sums
within the ranges, which are small enough for a task each, and the ranges' own
sums then say where every record begins in the whole order; the shards' ends
are the exact quantiles of that.

Equal keys form a group. A group of up to a 64th of a shard stays in one shard;
a larger one is cut between records, so a key of a third of all records is dealt
out like any others, and so are rows that are alike in everything: each has a
number of its own, given once and written. Records of more than a 64th of a shard
are placed first, equal ones together up to an eighth of a shard, each into the
shard with the fewest bytes so far, and the others fill up what these leave; there
are at most 64 for each shard. So two
shards differ by about a 64th of a shard, unless a record is longer than one.

A null key or tie is the least one. A null size is 1, as is one below. An empty
table has no shards. Columns keep their names and values, but for those that
have the names of the new ones.
"""

from __future__ import annotations

import heapq
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import table, without
from helixframe.plans.scratch import cut

#: A record or a group of more than this part of a shard is placed or cut singly.
UNIT = 64
#: Long equal records are placed together up to this part of a shard.
TOGETHER = 8
#: Ranges for each shard, and records drawn for each range.
RANGES, DRAWS = 8, 16
#: A range of so few records is never overfull; one of more than so many always is.
FEW_ROWS, MANY_ROWS = 256, 1_000_000
#: Below every tie and number.
LEAST = -(2**63) + 1
ORDER = ["key", "tie", "row"]
#: Rows of a file of a shard.
FILE_ROWS = 1_000_000

Splitter = tuple[int, int, int]


def _among(df: DataFrame, values: list[str], x: str, name: str) -> DataFrame:
    """``df`` with ``name``: how many of the sorted SQL literals aren't above ``x``. Blocks first, then within one."""
    if not values:
        return df.withColumn(name, F.lit(0))
    side = isqrt(len(values)) + 1
    blocks = [values[i : i + side] for i in range(0, len(values), side)]
    heads = ", ".join(b[0] for b in blocks)
    inner = ", ".join(f"array({', '.join(b)})" for b in blocks)
    df = df.withColumn(name, F.expr(f"size(filter(array({heads}), b -> b <= {x}))"))
    within = f"({name} - 1) * {side} + size(filter(element_at(array({inner}), {name}), b -> b <= {x}))"
    return df.withColumn(name, F.expr(f"CASE WHEN {name} > 0 THEN CAST({within} AS INT) ELSE 0 END"))


def _ranged(records: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """``records`` with ``range``: the number of splitters up to theirs."""
    values = [f"named_struct('key', {k}L, 'tie', {t}L, 'row', {r}L)" for k, t, r in splitters]
    return _among(records, values, "named_struct('key', key, 'tie', tie, 'row', row)", "range")


def _draw(records: DataFrame, share: Column, seed: int) -> list[tuple[Splitter, int]]:
    """Places in the order and how often they are drawn: the share's whole part, and once more by the odds of the rest. As many as the shares add up to."""
    odds = F.pmod(F.xxhash64(F.col("row"), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    drawn = records.withColumn("n", F.floor(share + odds)).filter("n > 0").select(*ORDER, "n").collect()
    return sorted(((r["key"], r["tie"], r["row"]), r["n"]) for r in drawn)


def _quantiles(drawn: list[tuple[Splitter, int]], parts: int, after: Splitter | None = None) -> list[Splitter]:
    """Up to parts - 1 splitters above ``after``: before a group where that is new, within it where the one before is at the same group."""
    total, seen, found = sum(n for _, n in drawn), 0, []
    for place, n in drawn:
        seen += n
        if seen * parts >= total * (len(found) + 1) and len(found) < parts - 1:
            last = found[-1] if found else after
            whole = (place[0], LEAST, LEAST)
            at = whole if last is None or last < whole else place
            while len(found) < parts - 1 and seen * parts >= total * (len(found) + 1):
                found.append(at)
    return sorted({x for x in found if after is None or x > after})


def _counts(records: DataFrame, splitters: list[Splitter]) -> dict[int, tuple[int, int]]:
    """Rows and bytes of each range: as many rows as there are ranges, whatever the table."""
    found = _ranged(records, splitters).groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    return {r["range"]: (r["n"], r["bytes"]) for r in found}


def _splitters(records: DataFrame, rows: int, total: int, ranges: int, *, max_rounds: int = 32) -> tuple[list[Splitter], dict[int, tuple[int, int]]]:
    """Splitters of which no range is overfull, and the ranges' counts."""
    share = F.col("size") * (DRAWS * ranges / total)
    cuts = _quantiles(_draw(records, share, 0), ranges, (LEAST - 1, LEAST, LEAST))
    for turn in range(1, max_rounds + 1):
        counts = _counts(records, cuts)
        most_rows, most_bytes = max(FEW_ROWS, min(MANY_ROWS, 2 * rows // ranges)), 2 * total / ranges
        over = {r: max(n / most_rows, size / most_bytes) for r, (n, size) in counts.items() if n > most_rows or n > FEW_ROWS and size > most_bytes}
        if not over:
            return cuts, counts
        # Half of the limit is aimed at, in records and in bytes alike.
        share = DRAWS * F.greatest(F.col("size") * (2 / most_bytes), F.lit(2 / most_rows))
        drawn = _draw(_ranged(records, cuts).filter(F.col("range").isin(*over)), share, turn)
        before = [(LEAST - 1, LEAST, LEAST), *cuts]
        for r, times in over.items():
            low, high = before[r], cuts[r] if r < len(cuts) else None
            own = [x for x in drawn if x[0] >= low and (high is None or x[0] < high)]
            cuts = cuts + _quantiles(own, ceil(2 * times), low)
        cuts = sorted(set(cuts))
    raise RuntimeError(f"ranges are still overfull after {max_rounds} rounds")


def _singly(records: DataFrame, total: int, shards: int) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """(row, shard, slot) of records of more than a 64th of a shard, the longest first, each to the shard of the fewest bytes; the shards' bytes and records.

    Equal ones go together as long as they are no more than an eighth of a shard.
    """
    long = records.filter(F.col("size") * (UNIT * shards) > total).select("size", *ORDER).collect()  # UNIT * shards at most
    alike: dict[tuple[int, int], list] = {}
    for r in sorted(long, key=lambda r: (r["tie"], r["row"])):
        alike.setdefault((r["key"], r["size"]), []).append(r)
    units = []
    for (key, size), rows in alike.items():
        together = size * len(rows) * TOGETHER * shards <= total
        units += [(-size * len(rows), key, rows)] if together else [(-size, key, [r]) for r in rows]
    heap, loads, held, placed = [(0, s) for s in range(shards)], [0] * shards, [0] * shards, []
    for minus, _, rows in sorted(units, key=lambda u: (u[0], u[1], u[2][0]["tie"], u[2][0]["row"])):
        load, s = heapq.heappop(heap)
        placed += [(r["row"], s, held[s] + i) for i, r in enumerate(rows)]
        held[s] += len(rows)
        loads[s] = load - minus
        heapq.heappush(heap, (loads[s], s))
    return placed, loads, held


def _ends(loads: list[int], rest: int) -> list[int]:
    """Twice the places, in the order of the other records, at which all shards but the last end: what is left to each up to one level."""
    level, up = float(rest), sorted(loads)
    for i in range(1, len(up) + 1):
        level = (rest + sum(up[:i])) / i
        if i == len(up) or level <= up[i]:
            break
    room = [max(0.0, level - x) for x in loads]
    last, at, ends = max(i for i, x in enumerate(room) if x > 0 or i == 0), 0.0, []
    for i, x in enumerate(room[:-1]):
        at += x
        ends.append(2 * rest if i >= last else min(2 * rest, round(2 * at)))
    return ends


def shard_by_bytes(df: DataFrame, shards: int, *, key: Column, tie: Column, size: Column) -> DataFrame:
    """``df`` with size, shard and slot (gapless from 0 in each shard).

    ``key`` and ``tie`` are longs: records are ordered by the key, equal ones by
    the tie. The rows are written once before they are dealt, so pass the columns
    that the shards need.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    keep = without(df, "size", "shard", "slot")
    rec = F.struct(*[F.col(f"`{c}`") for c in keep])
    number = [F.greatest(F.coalesce(c.cast("long"), F.lit(LEAST)), F.lit(LEAST)) for c in (key, tie)]
    records = df.select(rec.alias("rec"), number[0].alias("key"), number[1].alias("tie"), F.greatest(F.coalesce(size.cast("long"), F.lit(1)), F.lit(1)).alias("size"), F.monotonically_increasing_id().alias("row"))
    records = cut(records, "records")
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    final = [F.col("rec.*"), F.col("size"), F.col("shard"), F.col("slot")]
    if not rows:
        return records.select(F.col("rec.*"), "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed, loads, held = _singly(records, total, shards)
    long = F.col("size") * (UNIT * shards) > total
    places = df.sparkSession.createDataFrame(placed, "row long, shard int, slot long")
    out = records.filter(long).join(F.broadcast(places), "row").select(*final)  # UNIT * shards rows at most
    rest = records.filter(~long)
    rows, others = rows - len(placed), total - sum(loads)
    if not rows:
        return out
    splitters, counts = _splitters(rest, rows, others, RANGES * shards)
    ahead, before, begun = (0, 0), [], []
    for i in range(len(splitters) + 1):
        n, b = counts.get(i, (0, 0))
        before.append(f"{ahead[0]}L")
        begun.append(f"{ahead[1]}L")
        ahead = (ahead[0] + n, ahead[1] + b)
    at = _ranged(rest, splitters)
    order = Window.partitionBy("range").orderBy(*ORDER)
    through = Window.partitionBy("range").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = at.select("*", F.row_number().over(order).alias("i"), F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"), F.sum("size").over(through).alias("through"), F.sum("size").over(Window.partitionBy("range", "key")).alias("group"))
    # Twice the middle of the group, or of the record where the group is large.
    middle = F.when(F.col("group") * (UNIT * shards) <= total, 2 * F.col("through") - F.col("group")).otherwise(2 * F.col("upto") - F.col("size"))
    start = [F.expr(f"element_at(array({', '.join(x)}), range + 1)") for x in (begun, before)]
    at = at.select("rec", "size", (2 * start[0] + middle).alias("middle"), (start[1] + F.col("i") - 1).alias("i"))
    at = _among(at, [f"{x}L" for x in _ends(loads, others)], "middle", "shard")
    dealt = cut(at.select("rec", "size", "shard", "i"), "dealt")
    first = {r["shard"]: r["i"] for r in dealt.groupBy("shard").agg(F.min("i").alias("i")).collect()}  # a row for each shard
    shift = F.expr(f"element_at(array({', '.join(f'{held[s] - first.get(s, 0)}L' for s in range(shards))}), shard + 1)")
    return out.unionByName(dealt.select(F.col("rec.*"), "size", "shard", (F.col("i") + shift).alias("slot")))


def write_shards(dealt: DataFrame, path: str, *, file_rows: int = FILE_ROWS) -> None:
    """A folder for each shard, with files of up to ``file_rows`` records in the order of the slots: a shard is written by as many tasks as it needs."""
    part = F.floor(F.col("slot") / file_rows)
    dealt.repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("maxRecordsPerFile", file_rows).parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts side by side."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 16).alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"))
    dealt = shard_by_bytes(docs, 40, key=F.col("text_key"), tie=F.col("doc_id"), size=F.col("bytes"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
