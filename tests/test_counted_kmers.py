"""k-mers are counted as numbers, from packed runs in one exchange."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.operators import kmers


def turned(t):
    return t.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def plain(rows, k, last):
    found = Counter()
    for _, seq, cov in rows:
        for i in range(len(seq) - k + (1 if last else 0)):
            w = seq[i : i + k]
            found[w] += int(cov)
            found[turned(w)] += int(cov)
    return found


def some_nodes():
    rng = random.Random(11)
    whole = "".join(rng.choices("ACGT", k=3000))
    texts = [whole[i : i + rng.randint(20, 60)] for i in range(0, 2900, 13)] + ["A" * 90, "T" * 40, "ACGT" * 12, "", "ACG", whole * 3]
    return [(f"n{i}", t, float(rng.choice([1, 1, 2.7, 300, 1 << 40]))) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k", [1, 2, 11, 12, 16, 21, 30, 31, 33])
@pytest.mark.parametrize("last", [False, True])
def test_counts_are_those_of_all_windows(spark, k, last, monkeypatch):
    monkeypatch.setattr(kmers, "PIECE", 64)
    rows = some_nodes()
    nodes = spark.createDataFrame(rows, "node_id string, seq string, cov double").repartition(3)
    want = plain(rows, k, last)
    assert {r.kmer: r.cnt for r in kmers.kmer_count(nodes, k, last=last).collect()} == dict(want)
    if k % 2:  # a k-mer that is its own other strand counts once here
        high = sorted(r.kmer for r in kmers.high_kmers(nodes, k, 5, last=last).collect())
        assert high == sorted({min(w, turned(w)) for w, n in want.items() if n > 5})


def test_parts_are_added_up_in_turns(spark, monkeypatch):
    """A part whose windows aren't opened at once is counted like any other."""
    rows = some_nodes()
    nodes = spark.createDataFrame(rows, "node_id string, seq string, cov double").repartition(5)
    for name, n in (("PARTS", 2), ("ADDED_AT_ONCE", 64), ("GIVEN", 7), ("PACKED_AT_ONCE", 500)):
        monkeypatch.setattr(kmers, name, n)
    got = kmers._dealt_counts(nodes, 21, False, True, None).collect()
    assert len(got) == len({r.kmer for r in got})
    assert {r.kmer: r.cnt for r in got} == dict(plain(rows, 21, False))


def test_no_window_is_exchanged(spark):
    """Of 60,000 windows at most three bytes each are shuffled and nothing is written; a text of each took about eight."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("ACGT", k=36)) for _ in range(4000)]
    nodes = spark.createDataFrame([(f"n{i}", t, 1.0) for i, t in enumerate(texts)], "node_id string, seq string, cov double").coalesce(1)
    seen = spark.sparkContext._jsc.sc().statusStore()
    for made, rows in ((kmers.high_kmers(nodes, 21, 1), 0), (kmers.kmer_count(nodes, 21), 120_000)):
        before = seen.executorSummary("driver").totalShuffleWrite()
        assert made.agg(F.count("*")).first()[0] == rows
        assert seen.executorSummary("driver").totalShuffleWrite() - before < 180_000
