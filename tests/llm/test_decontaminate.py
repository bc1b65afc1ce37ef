import hashlib
import re

import numpy as np

from helixframe.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, size=10):
    w = words(text)
    hit, own = set(), set()
    for i, t in items:
        v = words(t)
        n = min(size, len(v))
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                own.add(str(i))
    return len(w), len(hit), sorted(own)


ITEMS = [(1, "The one: two three FOUR five six seven eight nine ten eleven"), (2, "short item"), (30, "é à"), (4, ""), (5, None), (6, "a a a a a a a a a a a"), (7, "short item")]
TEXTS = [
    None, "", "nothing here", "x the one two three four five six seven eight nine ten eleven y", "THE-ONE/two three four five six seven eight nine", "short  Item short item",
    "É à É à", "é à é à", "a " * 40, "one two three four five six seven eight nine ten the one two three four five six seven eight nine ten", "short", "item short", "a " * 9,
]


def test_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for chars in (8_000_000, 30):
        got = D.find_benchmark(docs, bench, block_chars=chars).collect()
        assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in got} == {i: brute(t, ITEMS) for i, t in enumerate(TEXTS)}


def test_remove(spark):
    docs = spark.createDataFrame([(1, "Ab, short  ITEM! z"), (2, None), (3, "clean.")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for chars in (8_000_000, 30):
        found = D.find_benchmark(docs, bench, block_chars=chars, remove=True)
        assert [r.text for r in found.orderBy("doc_id").collect()] == ["Ab, ! z", None, "clean."]


def test_index_against_scan():
    rng = np.random.default_rng(1)
    for top in (1, 2, 5):
        for n in (1, 2, 17, 300):
            stream = rng.integers(0, top + 1, n)
            index = D.FMIndex(stream)
            seq = stream.tolist()
            for m in (1, 2, 3, 5):
                patterns = rng.integers(1, top + 1, (6, m))
                lo, hi = index.search(patterns)
                for p, a, b in zip(patterns.tolist(), lo, hi, strict=True):
                    want = [i for i in range(n - m + 1) if seq[i : i + m] == p]
                    assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_query(spark):
    d = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in D.op6_decontaminate(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        n, hit, own = brute(r.text, items)
        x = got[r.doc_id]
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (n, hit, len(own), hit > 0)
        assert x.items_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.find_benchmark(none, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.find_benchmark(one, bench).first().n_words == 2


def test_long_texts_and_repeated_rows(spark):
    """A text whose stream of benchmark words alone is longer than a shard's, beside short ones; rows that are there twice."""
    rng = np.random.default_rng(5)
    item = " ".join(f"w{i}" for i in range(40))
    vocabulary = item.split()
    long = " ".join(vocabulary[k] for k in rng.integers(0, 40, D.SHARD + 50_000).tolist())
    long = f"{item} {long[: len(long) // 2]} zz {item} {long[len(long) // 2 :]}"
    rows = [(1, long, "a"), (2, "clean text of other words", "b"), (2, "clean text of other words", "b"), (3, " ".join(vocabulary[5:20]), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    got = sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in D.find_benchmark(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect())
    want = sorted((i, *brute(t, [(9, item)])) for i, t, _ in rows)
    assert got == want and got[0][2] >= 80
