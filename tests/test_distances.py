"""Distances and packed forms, against plain versions."""

import random

from pyspark.sql import functions as F

from helixframe.functions import dna


def some_pairs():
    rng = random.Random(8)
    texts = ["".join(rng.choices("ACGT", k=rng.choice([1, 2, 3, 35, 36, 63, 64, 65, 130]))) for _ in range(150)] + ["", "é", "aéb", "NAN", "ACNGT", "𝄞x𝄞"]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(400)]
    pairs += [(t, t[:5] + "G" + t[7:]) for t in texts[:100]]
    return [(i, a, b) for i, (a, b) in enumerate(pairs)] + [(-1, None, "A"), (-2, "A", None), (-3, "", "")]


def test_distances_are_those_of_each_pair(spark):
    df = spark.createDataFrame(some_pairs(), "i int, a string, b string").repartition(3)
    for r in df.select("*", dna.edits("a", "b").alias("e"), F.levenshtein("a", "b").alias("want"), dna.hamming("a", "b").alias("h")).collect():
        assert r.e == r.want, (r.a, r.b)
        assert r.h == (None if r.a is None or r.b is None else sum(p != q for p, q in zip(r.a, r.b, strict=False)))


def test_packed_forms(spark):
    texts = [a for _, a, _ in some_pairs()] + ["CACA", "CCCC", "GTGTG", "TTTTT"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", dna.dna_pack("t").alias("p"), dna.dna_unpack(dna.dna_pack("t")).alias("u"), dna.dna_unpack("t").alias("x")).collect():
        if r.t is None:
            assert r.p is r.u is r.x is None
            continue
        pairs = [r.t[i : i + 2] for i in range(0, len(r.t), 2)]
        assert r.p == "".join(dna.PACKED.get(x, "") for x in pairs)
        assert r.u == "".join(x for x in pairs if x in dna.PACKED)
        codes = {v: k for k, v in dna.PACKED.items()}
        assert r.x == "".join(codes.get(c, "") for c in r.t)


def test_no_lambda_runs_for_each_letter(spark):
    df = spark.createDataFrame([("ACGT",)], "seq string")
    plan = df.select(dna.dna_unpack(dna.dna_pack("seq")), dna.hamming("seq", dna.rc("seq")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def plain_similar(a, b, rate):
    n = min(len(a), len(b))
    if n > 1000:
        return sum(a[i * (n // 100) :][: n // 100] == b[i * (n // 100) :][: n // 100] for i in range(100)) >= 90
    row = list(range(n + 1))
    for i in range(n):
        new = [i + 1]
        for j in range(n):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (a[i] != b[j])))
        row = new
    return row[-1] / n < rate if n else None


def test_similar_texts(spark):
    rng = random.Random(2)
    rows = [(None, "A", 0), ("", "A", 0)]
    for n in (5, 36, 70, 1000, 1001, 1250):
        for k in (0, 1, n // 12, n // 8, n // 3):
            a = rng.choices("ACGT", k=n)
            b = list(a)
            for _ in range(k):
                b[rng.randrange(n)] = rng.choice("ACGT")
            rows.append(("".join(a), "".join(b) + "ACG" * (k % 2), k))
    df = spark.createDataFrame(rows, "a string, b string, k int")
    assert "substr" not in (made := df.select("*", dna.similar("a", "b", 0.1).alias("s")))._jdf.queryExecution().optimizedPlan().toString()
    for r in made.collect():
        assert r.s == (None if r.a is None else plain_similar(r.a, r.b, 0.1)), (len(r.a), r.k)
