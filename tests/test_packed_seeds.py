"""Frequencies of reads' k-mers and corrections come from packed runs."""

import random

import pytest

from helixframe.operators import kmers

NODES = "node_id string, seq string, cov double"
TURN = str.maketrans("ACGT", "TGCA")


def reads(seed, n=400):
    rng = random.Random(seed)
    whole = "".join(rng.choices("ACGT", k=260)) + "ACGT" * 12 + "A" * 40
    out = []
    for i in range(n):
        at = rng.randrange(len(whole) - 30)
        t = list(whole[at : at + rng.randrange(20, 45)])
        if rng.random() < 0.4 and len(t) > 12:
            t[rng.randrange(len(t))] = rng.choice("ACGT")
        t = "".join(t)
        out.append((f"n{i % (n - 3)}", t if i % 2 else t.translate(TURN)[::-1], float(rng.choice([0, 1, 1, 2, 7, 300]))))
    palindrome = "".join(rng.choices("ACGT", k=12))
    for b in "AACGTTTT":
        out.append((f"p{len(out)}", "C" + palindrome + b + palindrome.translate(TURN)[::-1] + "GA", 2.0))
    return [*out, ("long", whole * 20, 3.0), (None, whole[:50], 2.0)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("k", [21, 24])
def test_frequencies_are_those_of_windows(spark, monkeypatch, k):
    nodes = spark.createDataFrame(reads(k), NODES).repartition(3).cache()
    found = rows(kmers.read_kmer_freq(nodes, k))
    monkeypatch.setattr(kmers, "CODED", 0)
    assert found == rows(kmers.read_kmer_freq(nodes, k)) and len(found) > 2000


@pytest.mark.parametrize("few", [200_000, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_corrections_are_those_of_windows(spark, monkeypatch, seed, few):
    nodes = spark.createDataFrame(reads(seed), NODES).repartition(3).cache()
    monkeypatch.setattr(kmers, "FEW", few)
    found = rows(kmers.precorrect(nodes))
    monkeypatch.setattr(kmers, "_plain", lambda nodes: False)
    assert found == rows(kmers.precorrect(nodes)) and len(found) > 20


def test_texts_with_other_letters_are_corrected_as_before(spark):
    nodes = spark.createDataFrame([*reads(3), ("x", "ACGTN" * 9, 1.0)], NODES)
    assert not kmers._plain(nodes) and kmers.precorrect(nodes).count() > 10


def test_exchanges_are_packed(spark):
    rng = random.Random(4)
    nodes = spark.createDataFrame([(f"d{rng.randrange(10**6):06}", "".join(rng.choices("ACGT", k=36)), 1.0) for _ in range(20_000)], NODES).repartition(3).cache()
    nodes.count()
    seen = spark.sparkContext._jsc.sc().statusStore()
    for f, most in ((kmers.read_kmer_freq, 200), (kmers.precorrect, 120)):
        before = seen.executorSummary("driver").totalShuffleWrite()
        f(nodes).count()
        assert seen.executorSummary("driver").totalShuffleWrite() - before < most * 20_000
