"""Reads with numbers as ids: the same graph, exchanged as numbers; chains followed by ranges of ids."""

import random

import pytest

from helixframe.operators import chains, graph, overlap, reads, sides
from helixframe.plans.scratch import cut
from test_carried import rows, tiled

EDGES = "src string, src_dir string, dst string, dst_dir string, ovl int"
READS = "read_id string, seq string"


def made(spark, n=1500, seed=11):
    found = [(x[0], x[1]) for x in tiled(n, seed)]
    found += [(f"z{i}", s) for i, (_, s) in enumerate(found[:50])] + [("e", "ACGT" * 9)]
    return spark.createDataFrame(found, READS).repartition(3)


def numbers(spark):
    r = made(spark)
    return reads.read_dedup(r), cut(reads.numbered_dedup(r), "numbered")


def test_numbers_are_in_the_order_of_ids(spark):
    plain, n = numbers(spark)
    found = [tuple(x) for x in n.select("name", "seq", "cov", "node_id").collect()]
    assert sorted(x[:3] for x in found) == sorted(tuple(x) for x in plain.collect())
    by = sorted(found, key=lambda x: x[3])
    assert [x[0] for x in by] == sorted(x[0] for x in found) and len({x[3] for x in found}) == len(found)


def test_equal_ids_have_one_number(spark):
    twice = spark.createDataFrame([("a", "ACGTACCA"), ("b", "ACCCCCCC"), ("b", "AGGTTTTT"), (None, "AAAAAAAT"), ("c", "CCCTCCAA")], READS)
    found = {(x.name, x.seq): (x.node_id, x.first) for x in cut(reads.numbered_dedup(twice), "numbered").collect()}
    assert found["b", "ACCCCCCC"][0] == found["b", "AGGTTTTT"][0] and sorted(v[1] for k, v in found.items() if k[0] == "b") == [False, True]
    assert found[None, "AAAAAAAT"][0] is None and found["a", "ACGTACCA"][0] < found["b", "ACCCCCCC"][0] < found["c", "CCCTCCAA"][0]


def test_reduced_by_numbers_is_what_texts_give(spark):
    plain, n = numbers(spark)
    plain = plain.cache()
    whole = overlap.with_extensions(plain, 21, high=2000)
    want = set(rows(graph.transitive_reduction(whole, plain)))
    found = cut(overlap.reduced(n, 21, high=2000), "reduced")
    assert set(rows(reads.named(found, n, "src", "dst"))) == want and found.count() == len(want)
    degrees = {(x.src, x.src_dir): x.deg for x in graph.degrees(found.select("src", "src_dir")).collect()}
    assert all(degrees[x.src, x.src_dir] == x.deg for x in found.collect())
    text = reads.named(found, n, "src", "dst").select(*overlap.EDGE).cache()
    assert set(rows(reads.named(graph.compressible(found), n, "src", "dst"))) == set(rows(graph.compressible(text)))
    a, b = chains.compress_chains(n, found)
    c, d = chains.compress_chains(plain, text)
    got = reads.named(a, n, "node_id").select("node_id", "seq", "cov").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, c.select("node_id", "seq", "cov").collect()))
    assert sorted(rows(reads.named(b, n, "src", "dst"))) == sorted(rows(d))


@pytest.mark.parametrize("size", [16, 31, 32, 43])
def test_packed_edges_come_back(size):
    import numpy as np

    rng = np.random.default_rng(size)
    n = 300
    words = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
    length = rng.integers(0, size + 1, n)
    length[0] = size
    cut_ = 2 * (64 - length)
    whole = [((int(h) << 64 | int(w)) >> c << c) % 2**128 for h, w, c in zip(*words, cut_.tolist(), strict=True)]
    high, low = np.array([x >> 64 for x in whole], np.uint64), np.array([x % 2**64 for x in whole], np.uint64)
    e = (rng.integers(0, 2**40, n), rng.integers(0, 2**40, n), rng.integers(21, 64, n), length, high, low)
    back = sides.unpack(sides.pack(e).column(1).to_pylist())
    key = lambda e: sorted(zip(*(c.tolist() for c in e), strict=True))
    assert key(back) == key(e)


def test_long_sides_and_texts_are_reduced_too(spark):
    """Against the stack that reads a side's texts in order."""
    import numpy as np

    rng = random.Random(3)
    own = []
    for side, many, most in ((2, 400, 12), (5, 40, 40), (8, 900, 6)):
        for j in range(many):
            own.append((side, "".join(rng.choices("AC", k=rng.randrange(0, most))), rng.randrange(21, 40), 100 + 2 * j))
    src, text, ovl, dst = zip(*own, strict=True)
    b = next(sides._words([__import__("pyarrow").RecordBatch.from_pylist([{"src": s >> 1, "src_dir": "fr"[s & 1], "dst": d >> 1, "dst_dir": "f", "ovl": o, "ext": t} for s, t, o, d in own])]))
    kept = set(sides.not_implied(b).tolist())
    order = sorted(range(len(own)), key=lambda i: (src[i], text[i], -ovl[i], dst[i]))
    marks = graph._implied((src[i] >> 1, "fr"[src[i] & 1], 0, text[i], ovl[i], dst[i] >> 1, None, None) for i in order)
    assert kept == {i for i, m in zip(order, marks, strict=True) if not m} and isinstance(b[4], np.ndarray)


def test_a_chain_of_neighbours_settles_at_once(spark, monkeypatch):
    """Before, each round doubled the jumps of all vertices: twelve rounds for this chain."""
    n = 3000
    links = [(f"r{i:05}", "f", f"r{i + 1:05}", "f", 30) for i in range(n - 1)]
    links += [(d, "r", s, "r", o) for s, _, d, _, o in links]
    ring = [(f"s{i:03}", "f", f"s{(i + 1) % 40:03}", "f", 25) for i in range(40)]
    ring += [(d, "r", s, "r", o) for s, _, d, _, o in ring]
    edges = spark.createDataFrame(links + ring, EDGES)
    seen, whole = [], chains.counted
    monkeypatch.setattr(chains, "counted", lambda *a, **k: seen.append(1) or whole(*a, **k))
    found = {(x.id, x.dir): (x.hid, x.hdir, x.pos) for x in chains.chain_places(edges).collect()}
    assert len(found) == 2 * n + 80 and len(seen) <= 8
    assert all(found[f"r{i:05}", "f"] == ("r00000", "f", i) and found[f"r{i:05}", "r"] == (f"r{n - 1:05}", "r", n - 1 - i) for i in range(n))
    assert all(found[f"s{i:03}", "f"] == ("s000", "f", i) for i in range(40))
