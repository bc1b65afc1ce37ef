import math
import string
import zlib
from collections import Counter

import numpy as np
import xxhash

from helixframe.llm import quality


def test_pairs_by_sum_of_squares():
    rng = np.random.default_rng(3)
    m = quality.Machine(50, 4)
    m.w, m.v, m.bias = rng.normal(size=50), rng.normal(size=(50, 4)), 0.3
    place, value = np.array([1, 7, 9, 30]), rng.normal(size=4)
    want = m.bias + m.w[place] @ value + sum(value[i] * value[j] * (m.v[place[i]] @ m.v[place[j]]) for i in range(4) for j in range(i))
    assert np.isclose(m.raw(place, value, np.zeros(1, int))[0][0], want)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in quality.op7_quality(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    test = [(got[i].score, got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    bad, good = [s for s, _, y in test if y == 0], [s for s, _, y in test if y == 1]
    auc = np.mean([(a < b) + 0.5 * (a == b) for a in bad for b in good])
    accuracy = np.mean([p == y for _, p, y in test])
    print("held out:", len(test), "AUC", auc, "accuracy", accuracy)
    assert auc > 0.98 and accuracy > 0.97


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", None), (1, None, "a"), (3, "w " * 50000, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 1)], "doc_id long, quality int")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert [r.score for r in quality.score(docs, quality.train(docs, none)).collect()] == [0.5] * 5
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def plain_score(m, text):
    """The machine's score by its definition: each word and bin by itself, each pair once."""
    words = text.split()
    counts = Counter(words)
    strip = string.punctuation.encode()
    vector = {}
    for w, n in counts.items():
        k = xxhash.xxh32(w.lower().strip(strip), seed=7).intdigest() % 16384
        vector[k] = vector.get(k, 0) + n
    vector = {k: math.log(1 + n) for k, n in vector.items()}
    length = max(1e-9, math.sqrt(sum(x * x for x in vector.values())))
    vector = {k: x / length for k, x in vector.items()}
    n, size = max(1, len(text)), max(1, len(words))
    odd = [c for c in text if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" and chr(c) not in ".,;:'\"-()?!"]
    digits = sum(48 <= c <= 57 for c in text)
    letters = len(text) - digits - len(odd) - sum(c in b" \t\n\x0b\x0c\r" for c in text)
    lines = text.split(b"\n")
    shares = [sum(65 <= c <= 90 for c in text) / max(1, letters), digits / n, len(odd) / n, text.count(b"|") / size, text.count(b"!") / size, sum(a == b for a, b in zip(words, words[1:])) / size, 1 - len(counts) / size, 1 - len(set(lines)) / len(lines), max(counts.values(), default=0) / size]
    cuts = [1e-9, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.7, 0.9]
    bins = [sum(x >= c for c in cuts) for x in shares] + [min(9, x.bit_length() // 2) for x in (len(words), n // size)]
    for i, b in enumerate(bins):
        vector[16384 + 10 * i + b] = 0.5
    raw = m.bias + sum(m.w[k] * x for k, x in vector.items())
    items = list(vector.items())
    v = np.array([m.v[k] * x for k, x in items])
    dots = v @ v.T
    raw += (dots.sum() - np.trace(dots)) / 2
    return 1 / (1 + math.exp(-max(-30, min(30, raw))))


def test_scores_by_the_definition(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter(~quality.held_out()))
    got = {r.doc_id: r for r in quality.op7_quality(spark, d).collect()}
    for r in docs.collect():
        assert np.isclose(got[r.doc_id].score, plain_score(model, (r.text or "").encode()), atol=1e-9)
    texts = ["", "!!! ||| 12 A", "é\n\nX x X", "w " * 100]
    rows = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert all(np.isclose(r.score, plain_score(model, texts[r.doc_id].encode())) for r in rows)
