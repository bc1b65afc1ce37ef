import random
import re

import numpy as np
import xxhash
import pytest

from helixframe.llm import simhash
from helixframe.llm.components import connected_components


def brute(prints, radius):
    """The least index that each reaches."""
    n = len(prints)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j])) <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_tables_meet():
    rng = random.Random(4)
    for bits, radius, blocks in ((64, 3, 5), (64, 3, 4), (16, 2, 4)):
        tables = simhash.pigeonhole(bits, radius, blocks)
        for _ in range(200):
            flipped = set(rng.sample(range(bits), radius))
            assert any(not flipped & set(t) for t in tables)


@pytest.mark.parametrize("tile", [8192, 40])
def test_near_fingerprints(spark, tile):
    rng = random.Random(tile)
    prints = [bytes(8)]
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            prints.append(x.to_bytes(8, "big"))
            base = rng.choice([base, x])
    prints = sorted(set(prints))
    reps = spark.createDataFrame([(p,) for p in prints], "fp binary")
    links = simhash.links(reps, simhash.pigeonhole(64, 3, 5), 3, tile=tile)
    found = {bytes(r.node): bytes(r.root) for r in connected_components(links, "a", "b").collect()}
    assert [found.get(p, p) for p in prints] == [prints[k] for k in brute(prints, 3)]


def test_runs_of_all_sizes():
    rng = np.random.default_rng(1)
    for words in (1, 2):
        g, pop, fp = [], [], []
        for k, n in enumerate([1, 2, 3, 64, 65, 700, 1, 1200]):
            base = rng.integers(0, 2**63, (1, words), dtype=np.uint64)
            x = base ^ (np.uint64(1) << rng.integers(0, 14, (n, words), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, (n, words), dtype=np.uint64))
            c = np.bitwise_count(x).sum(1).astype(np.int32)
            order = np.argsort(c, kind="stable")
            g += [k] * n
            pop += c[order].tolist()
            fp.append(x[order])
        g, pop, fp = np.array(g), np.array(pop), np.concatenate(fp)
        parent = simhash.link_runs(g, pop, fp, 2)
        at = 0
        for n in [1, 2, 3, 64, 65, 700, 1, 1200]:
            raw = fp[at : at + n]
            want = np.arange(n)
            near = np.bitwise_count(raw[:, None] ^ raw[None]).sum(2) <= 2
            for _ in range(n):
                new = np.where(near, want[None, :], n).min(1)
                if (new == want).all():
                    break
                want = new
            assert (parent[at : at + n] - at == want).all()
            at += n


def test_edge_cases(spark):
    rows = [(3, None), (1, ""), (2, "a b c d"), (2, "a b c d"), (None, "A  b\tC d"), (9, "word " * 40000), (8, "x"), (None, "x")]
    df = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(3, 1), (1, 1), (2, 2), (2, 2), (None, 2), (9, 9), (8, 8), (None, 8)], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_stars(spark):
    rng = random.Random(7)
    n = 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)] + [(500, k) for k in range(501, 600)] + [(None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def plain_print(text):
    """Bit by bit, of the contract's words: white space of ASCII only, A-Z in small letters."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)).to_bytes(8, "big")


def test_fingerprints_by_the_definition():
    texts = [None, "", " \t\n", "A", "a b", "a b c", "A\xa0B c\u2003d e", "\x1ca b\x85c d e f", "é É ß Σ x y z", "to be or not to be " * 300, "\x0b\x0cx y\rz"]
    assert [simhash.majority(simhash.shingle_hashes((t or "").encode(), 3), 1) for t in texts] == list(map(plain_print, texts))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    prints = [plain_print(t) for _, t in docs]
    want = {i: (p.hex(), docs[k][0]) for (i, _), p, k in zip(docs, prints, brute(prints, 3))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, d).collect()} == want
