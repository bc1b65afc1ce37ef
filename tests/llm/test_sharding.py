"""Shards of near equal bytes: every record once, slots without gaps, groups side by side, hot groups cut."""

import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helixframe.llm import sharding as S

SCHEMA = "doc_id long, text string, size int, range string, rec int"


def dealt(spark, rows, shards, parts=5):
    df = spark.createDataFrame([(i, t, -1, "r", 3) for i, t in rows], SCHEMA).repartition(parts)
    text = F.coalesce("text", F.lit(""))
    return S.shard_by_bytes(df, shards, key=F.xxhash64(text), tie=F.col("doc_id"), size=F.octet_length(text) + 16)


def check(out, rows, shards, slack):
    size = {}
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    slots, loads = defaultdict(list), [0] * shards
    for r in out:
        size[r.doc_id, r.text] = len((r.text or "").encode()) + 16
        assert r.size == size[r.doc_id, r.text]
        assert (r.range, r.rec) == ("r", 3)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) <= set(range(shards))
    mean, longest = sum(loads) / shards, max(size.values())
    assert max(loads) <= max(mean * (1 + slack), longest) and (longest > mean or min(loads) >= mean * (1 - slack))
    return loads


def test_many_small_records_and_a_hot_group(spark):
    """A third of the rows have one text, some of them the same id too; small groups of copies stay together."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abcdé ", k=rng.randrange(0, 400)))) for i in range(6000)]
    rows += [(10_000 + i // 9, "the same text of many" * 5) for i in range(3000)]
    rows += [(20_000 + i, f"copy {i // 4} " * 9) for i in range(400)]
    out = dealt(spark, rows, 8).collect()
    check(out, rows, 8, 1 / 16)
    shards = defaultdict(set)
    for r in out:
        shards[r.text].add(r.shard)
    assert len(shards["the same text of many" * 5]) > 1
    assert all(len(v) == 1 for t, v in shards.items() if t.startswith("copy"))
    assert sorted((r.doc_id, r.shard, r.slot) for r in out) == sorted((r.doc_id, r.shard, r.slot) for r in dealt(spark, rows, 8).collect())


def test_long_records_nulls_ties(spark):
    rows = [(1, "x" * 90_000), (2, "y" * 60_000), (3, "z" * 60_000), (None, None), (None, None), (4, ""), (4, ""), (4, None), *((10 + i, "w" * (i % 50)) for i in range(500))]
    check(dealt(spark, rows, 4).collect(), rows, 4, 1 / 8)


def test_long_copies_stay_together(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("abc", k=100))) for i in range(4000)] + [(9000 + i, f"{i // 3} " * 1200) for i in range(9)]
    out = dealt(spark, rows, 4).collect()
    check(out, rows, 4, 1 / 16)
    where = defaultdict(set)
    for r in out:
        where[r.text].add(r.shard)
    assert all(len(v) == 1 for t, v in where.items() if len(t) > 1000)


def test_alike_rows_only(spark):
    """Nothing but the rows' own numbers can cut this."""
    rows = [(7, "same")] * 4000
    check(dealt(spark, rows, 5).collect(), rows, 5, 1 / 16)


@pytest.mark.parametrize("rows", [[], [(1, "one")], [(i, None) for i in range(7)]])
def test_few_or_no_rows(spark, rows):
    out = dealt(spark, rows, 3).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_overfull_ranges_are_subdivided(spark):
    """Many records of few bytes in one stretch of the order, which a sample by bytes hardly sees."""
    df = spark.range(20_000).select(F.col("id").alias("key"), F.col("id").alias("tie"), F.col("id").alias("row"), F.when(F.col("id") < 18_000, 1).otherwise(5000).cast("long").alias("size"))
    rows, total = df.agg(F.count("*"), F.sum("size")).first()
    splitters, counts = S._splitters(df, rows, total, 40)
    assert sum(n for n, _ in counts.values()) == rows and sum(b for _, b in counts.values()) == total
    assert all(n <= 1000 and (n <= S.FEW_ROWS or b <= 2 * total / 40) for n, b in counts.values())
    assert splitters == sorted(set(splitters))


def test_files_of_shards(spark, tmp_path):
    rows = [(i, f"text {i}" * (i % 9)) for i in range(300)]
    out = dealt(spark, rows, 3)
    S.write_shards(out, f"file://{tmp_path}/s", file_rows=40)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert Counter(map(tuple, back.select("doc_id", "text", "shard", "slot").collect())) == Counter(map(tuple, out.select("doc_id", "text", "shard", "slot").collect()))
    for f in tmp_path.glob("s/shard=*/*.parquet"):
        slots = pq.read_table(f, partitioning=None).column("slot").to_pylist()
        assert len(slots) <= 40 and slots == sorted(slots)


def test_query(spark):
    out = S.op11_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    import zlib

    assert {r.doc_id: (r["size"], r.text_crc32) for r in out} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs.items()}
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)} and {r.shard for r in out} == set(range(40))
