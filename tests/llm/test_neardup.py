import random

import numpy as np
import pytest

import corpus_pipeline as P
from helixframe.llm import neardup


def shingles(t):
    w = t.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    """Of each component by brute force the least id."""
    sets = [(i, shingles(t or "")) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if (find(i) != find(j)) and alike(a, b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def some_documents(seed):
    """Pairs on both sides of 0.8: a text and the same text with its end replaced, of 1 to 400 words; lines repeated in some."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = [(0, None), (1, "  ")]
    for k in range(150):
        n = rng.choice([1, 3, 5, 8, 9, 12, 30, 60, 120, 300, 400])
        text = [word() for _ in range(n)]
        share = rng.uniform(0.7, 0.95)
        m = max(0, n - 4)
        same = round(2 * m * share / (1 + share))
        other = [*text[: same + 4], *(word() for _ in range(m - same))] if m else [*text]
        if k % 10 == 0:
            text = text + text[:20] * 30
        rows += [(10 + 2 * k, " ".join(text)), (11 + 2 * k, " ".join(other))]
    return rows


def test_every_pair_at_0_8_and_no_other(spark):
    rows = some_documents(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = kept(rows)
    got = {r.doc_id for r in P.near_dedup(spark, docs, "").collect()}
    assert 180 < len(want) < len(rows) - 50
    assert (sorted(want - got), sorted(got - want)) == ([], [])


@pytest.mark.parametrize("tile", [4, 2048])
def test_chains_and_large_groups(spark, tile):
    """Copies of one text that are near to it but not to each other, and a chain of small steps."""
    rng = random.Random(5)
    text = [f"a{k}" for k in range(104)]
    rows = []
    for k in range(60):
        w = list(text)
        at = rng.randrange(len(w) - 12)
        w[at : at + 9] = [f"c{k}x{j}" for j in range(9)]
        rows.append((100 + k, " ".join(w)))
    rows += [(99, " ".join(text))] + [(200 + k, " ".join(f"s{j}" for j in range(8 * k, 8 * k + 104))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.component_id for r in neardup.near_copies(df, tile=tile).collect()}
    assert got == kept(rows)


def test_miss_rate():
    assert (1 - 0.8**neardup.ROWS) ** neardup.BANDS < 1e-5


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 3000):
        x, y = (np.unique(rng.integers(0, 4 * n + 1, n).astype(np.uint64)) for _ in range(2))
        p, q = (np.frombuffer(neardup.parities(h), np.uint64) for h in (x, y))
        assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(x, y))
