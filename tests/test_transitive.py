"""The sorted-prefix scan against all pairs of a side, on hubs, ties and sides that several tasks read."""

import random

import pytest

from helixframe.operators import graph as G

NODES = "node_id string, seq string, cov double"
EDGES = "src string, src_dir string, dst string, dst_dir string, ovl int"


def plain(edges):
    """Marks among (src, src_dir, dst, ovl, ext) by the rule, pair by pair."""
    out, sides = set(), {}
    for e in edges:
        sides.setdefault(e[:2], []).append(e)
    for (_, d), side in sides.items():
        for x in side:
            for y in side:
                if not x[4].startswith(y[4]) or (x[3] == y[3] and len(x[4]) == len(y[4])):
                    continue
                a, b = (y[3] + len(y[4]) + 1) // 2, (x[3] + len(x[4]) + 1) // 2
                by_id = y[2] < x[2] if d == "f" else y[2] > x[2]
                if y[3] > x[3] or y[3] == x[3] and (a < b or a == b and by_id):
                    out.add(x[:4])
    return out


def tables(spark, edges, parts=3):
    nodes = {(d, o, t): "A" * o + t for _, _, d, o, t in edges}
    assert len({d for d, *_ in nodes}) == len(nodes)  # a node is the neighbour of one overlap here
    n = spark.createDataFrame([(d, s, 1.0) for (d, _, _), s in nodes.items()], NODES)
    e = spark.createDataFrame([(s, sd, d, "f", o) for s, sd, d, o, _ in edges], EDGES).repartition(parts)
    return e, n


def marks(spark, edges):
    return {(r.src, r.src_dir, r.dst, r.ovl) for r in G.transitive_marks(*tables(spark, edges)).collect()}


def random_edges(n, sides, seed, letters="AC", longest=9, overlaps=(3, 4, 5)):
    rng, out = random.Random(seed), []
    for i in range(n):
        out.append((f"s{rng.randrange(sides)}", rng.choice("fr"), f"d{rng.randrange(10**9):09d}_{i}", rng.choice(overlaps), "".join(rng.choices(letters, k=rng.randrange(0, longest)))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    edges = random_edges(400, 4, seed)
    assert marks(spark, edges) == plain(edges) != set()


def test_sides_that_are_cut(spark, monkeypatch):
    """Every side is large here, and prefixes of later parts' texts lie in earlier parts."""
    monkeypatch.setattr(G, "SIDE_ROWS", 40)
    monkeypatch.setattr(G, "DRAWS", 4)
    edges = random_edges(1500, 2, 9, longest=12, overlaps=(3, 3, 4, 5))
    dealt = G._dealt(*tables(spark, edges))
    parts = dealt.select(*G.SIDE, "part").distinct().count()
    assert parts > 20 and dealt.filter("dst IS NOT NULL").count() == len(edges) < dealt.count()
    assert marks(spark, edges) == plain(edges)


def test_hub_of_many_lengths(spark):
    """10,000 edges of 10,000 lengths, each a prefix of the next: a row for each edge, not for each pair."""
    n, rng = 10_000, random.Random(1)
    text = "".join(rng.choices("ACGT", k=n))
    edges = [("h", "f", f"d{i:06d}", 5, text[:i]) for i in range(n)]
    e, nodes = tables(spark, edges)
    assert G._dealt(e, nodes).count() == n
    # Equal overlaps: each text but the empty one is implied by the one before, or by a shorter one.
    got = {r.dst for r in G.transitive_marks(e, nodes).collect()}
    want = {d for _, _, d, o, t in edges if len(t) >= 2 or (len(t) == 1 and (o + 1) // 2 <= (o + 2) // 2)}
    assert got == want


def test_no_edges(spark):
    e, n = spark.createDataFrame([], EDGES), spark.createDataFrame([], NODES)
    assert G.transitive_marks(e, n).collect() == []
