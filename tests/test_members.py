"""Reads and their mates meet packed and once."""

import random
from collections import Counter

import pytest

from helixframe.functions.dna import mate_name
from helixframe.operators import reads, repeats

TURN = str.maketrans("ACGT", "TGCA")


def some_reads(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ACGT", k=rng.randint(5, 80))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        t = texts[0] if i % 5 == 0 else rng.choice(texts)
        out.append((f"r{rng.randrange(10**6):06}p{i}_{1 + i % 2}", t if rng.random() < 0.5 else t.translate(TURN)[::-1]))
    return out


def written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("batch", [7, 10000])
def test_contained_as_by_hand(spark, batch, monkeypatch):
    monkeypatch.setattr(reads, "AT_ONCE", 50)
    rows = some_reads(600, batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, "read_id string, seq string").repartition(3)
        found = sorted(map(tuple, reads.mark_contained(df).collect()))
        nodes = sorted(map(tuple, reads.redundant_removal(reads.mark_contained(df)).collect()))
        held = dict(map(tuple, reads.members(df).select("read_id", "node_id").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for i, t in rows:
        by.setdefault(min(t, t.translate(TURN)[::-1]), []).append(i)
    least = {i: min(ids) for ids in by.values() for i in ids}
    size = {min(ids): float(len(ids)) for ids in by.values()}
    assert found == sorted((i, t, size.get(i, 1.0), i not in size) for i, t in rows)
    assert nodes == sorted((i, t, size[i]) for i, t in rows if i in size)
    assert held == least


@pytest.mark.parametrize("same", [True, False])
def test_an_id_twice_is_an_error(spark, same):
    df = spark.createDataFrame([("a", "ACGTA"), ("a", "ACGTA" if same else "GGGTA"), ("b", "CCCCC")], "read_id string, seq string")
    with pytest.raises(Exception, match="not exactly one node: a"):
        reads.redundant_removal(reads.mark_contained(df)).collect()


def test_mates_as_by_hand(spark):
    rng = random.Random(4)
    rows = [(f"n{rng.randrange(6)}", f"p{rng.randrange(40)}_{rng.randrange(1, 4)}") for _ in range(300)]
    df = spark.createDataFrame(rows, "node_id string, read_id string")
    names = dict(map(tuple, df.select("read_id", mate_name("read_id").alias("m")).distinct().collect()))
    want = Counter((a, b) for a, x in rows for b, y in rows if names[x] == y)
    assert {(r.a, r.b): r.mates for r in repeats.mate_counts(df).collect()} == dict(want)


def test_little_is_exchanged(spark):
    """Less than 60 bytes a read, with its result's id: texts were sent twice before, and their nodes once more."""
    rng = random.Random(9)
    rows = [(f"d{i // 50}p{i % 50}_{1 + i % 2}", "".join(rng.choices("ACGT", k=36))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "read_id string, seq string").repartition(3).cache()
    assert df.count() == 20_000
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written(spark)
        reads.redundant_removal(reads.mark_contained(df)).write.format("noop").mode("overwrite").save()
        now = written(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert now < 60 * 20_000
