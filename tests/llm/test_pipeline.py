import re
from collections import Counter

import pytest

import corpus_pipeline as P
from helixframe.llm import quality
from helixframe.plans.scratch import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for _, f in P.STAGES:
        docs = cut(f(spark, docs, D), "stage")
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_quality_follows_scores(spark, stages):
    scores = {r.doc_id: r.predicted for r in quality.op7_quality(spark, D).collect()}
    assert {r.doc_id for r in stages[0].collect()} == {i for i, p in scores.items() if p == 1}


def test_lines(stages):
    before = {r.doc_id: r.text for r in stages[0].collect()}

    def key(x):
        return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))

    seen = Counter(k for t in before.values() for k in {key(x) for x in t.split("\n")} if k)
    want = {i: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10) for i, t in before.items()}
    assert {r.doc_id: r.text for r in stages[1].collect()} == {i: t for i, t in want.items() if t.strip() or t == before[i]}


def shingles(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_groups(rows):
    """The least id of each group of texts with Jaccard 0.8 or more, by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows.items()}
    where, root = {}, {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in where[x] if j < i)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in rows}


def test_near_copies_are_those_of_all_pairs(stages):
    """Exactly one document of each group stays: none that should go is missed, none that should stay goes."""
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[1:3])
    want = near_groups(before)
    assert len(want) < len(before)
    assert set(after) == want and all(after[i] == before[i] for i in after)


ODD = [
    (None, "alpha beta gamma delta epsilon zeta eta theta"), (None, "alpha beta gamma delta epsilon zeta eta theta"), (5, "alpha beta gamma delta epsilon zeta eta theta"), (6, None), (6, ""), (7, "one two three four five six seven eight nine ten eleven"),
    (7, "one two three four five six seven eight nine ten eleven"), (7, "clean and apart from all the others here"), (8, "w" * 40_000), (9, "word and word " * 40_000), (10, "one two three four five six seven eight nine ten eleven twelve"), (11, "  \n \t "),
]


@pytest.mark.parametrize("number", range(5))
def test_odd_rows(spark, number):
    """Null ids and texts, repeated rows, very long texts, columns with names of the operators' own."""
    names = ["n_lines", "key", "score", "component_id", "spans", "doc", "h1"]
    rows = [(i, t, "en", "web", 0, *["x"] * len(names)) for i, t in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    _, stage = P.STAGES[number]
    got = stage(spark, docs, D)
    if number < 4:
        assert got.columns == docs.columns
    out = [(r.doc_id, r.text) for r in got.collect()] if number < 4 else None
    if number == 0:
        assert {(i, t or "") for i, t in out} <= {(i, t or "") for i, t in ODD}
    elif number == 1:
        assert sorted((i or 0, t or "") for i, t in out) == sorted((i or 0, t or "") for i, t in ODD)
    elif number == 2:
        kept = sorted((i or 0, (t or "").strip()[:20]) for i, t in out)
        assert kept == [(5, "alpha beta gamma del"), (6, ""), (7, "clean and apart from"), (7, "one two three four f"), (8, "w" * 20), (9, "word and word word a")]
    elif number == 3:
        assert sorted((i or 0, t or "") for i, t in out) == sorted((i or 0, t or "") for i, t in ODD)
    else:
        pieces = got.collect()
        assert {r.doc_id for r in pieces} == {i for i, _ in ODD}
        assert sum(r.length for r in pieces if r.doc_id == 6) == 2 and sum(r.length for r in pieces if r.doc_id == 9) > 100_000


def test_no_benchmark_window_is_left(spark, stages):
    from helixframe.llm import decontaminate

    found = decontaminate.find_benchmark(stages[3], spark.read.parquet(f"{D}/benchmark.parquet"))
    left = found.filter("size(spans) > 0").count()
    before = decontaminate.find_benchmark(stages[2], spark.read.parquet(f"{D}/benchmark.parquet")).filter("size(spans) > 0").count()
    assert before > 0 and left == 0
    clean = {r.doc_id: r.text for r in decontaminate.find_benchmark(stages[2], spark.read.parquet(f"{D}/benchmark.parquet")).filter("size(spans) = 0").collect()}
    after = {r.doc_id: r.text for r in stages[3].collect()}
    assert all(after[i] == t for i, t in clean.items())


def test_packing_holds_every_document(stages):
    pieces = stages[4].collect()
    docs = {r.doc_id for r in stages[3].collect()}
    total = Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert set(total) == docs and all(total[r.doc_id] == r.doc_tokens for r in pieces)


def test_empty(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, f in P.STAGES:
        docs = cut(f(spark, docs, D), "none")
        assert docs.count() == 0
