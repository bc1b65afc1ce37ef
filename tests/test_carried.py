"""Short reads' overlaps carry their extensions: no exchange of most overlaps, none of implied edges, and the same graph."""

import random

import numpy as np
import pyarrow as pa
import pytest

from helixframe.operators import graph, kmers, meeting, overlap

NODES = "node_id string, seq string, cov double"


def tiled(n, seed, repeats=30):
    """Reads of both strands over a text with repeats, rows of one letter and periods."""
    rng = random.Random(seed)
    piece = "".join(rng.choices("ACGT", k=50))
    whole = "".join("".join(rng.choices("ACGT", k=n // repeats)) + piece for _ in range(repeats)) + "A" * 60 + "ACG" * 20
    turn = str.maketrans("ACGT", "TGCA")
    texts = sorted({whole[i : i + rng.randint(22, 40)] for i in range(0, len(whole) - 22, 3)})
    return [(f"n{i}", t if i % 2 else t.translate(turn)[::-1], float(1 + i % 9)) for i, t in enumerate(texts)]


def rows(df):
    return sorted(map(tuple, df.select(*overlap.EDGE).collect()))


@pytest.mark.parametrize("up", [2000, 15])
def test_same_graph_as_by_joins(spark, up, monkeypatch):
    nodes = spark.createDataFrame(tiled(1200, up), NODES).repartition(3).cache()
    carried = overlap.with_extensions(nodes, 21, high=up, up_kmer=up)
    stop = kmers.high_kmers(nodes, 21, up)
    assert stop.isEmpty() == (up == 2000)
    monkeypatch.setattr(meeting, "LONGEST", 0)
    plain = overlap.overlaps(nodes, 21, stop=stop, up_kmer=up)
    assert rows(carried) == rows(plain) and carried.count() > 2000
    want = {tuple(r) for r in graph.extensions(plain, nodes).select(*overlap.EDGE, "ext", "dst_cov", "dst_len").collect()}
    assert {tuple(r) for r in graph.extensions(carried, nodes).select(*overlap.EDGE, "ext", "dst_cov", "dst_len").collect()} == want
    assert rows(graph.transitive_reduction(carried, nodes)) == rows(graph.transitive_reduction(plain, nodes))


def test_most_overlaps_are_not_exchanged(spark):
    """Of a text without repeats no overlap is open: its other copy is found where that one's k-mer is."""
    rng = random.Random(3)
    whole = "".join(rng.choices("CGT", k=3000))
    nodes = spark.createDataFrame([(f"n{i}", whole[i : i + 36], 1.0) for i in range(0, 2900, 3)], NODES)
    met = meeting.met(nodes, 21, None, None, 2000, True)
    assert met.count() > 5000 and met.filter("open").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_whole_sides_against_the_stack(seed, monkeypatch):
    """Marks of sides as numbers are those of texts read one after another, ties by id and sides of many edges included."""
    rng = random.Random(seed)
    monkeypatch.setattr(graph, "PAIRED", 40)
    edges = sorted((f"s{rng.randrange(30) ** 2 // 40}", rng.choice("fr"), f"d{rng.randrange(10**6)}_{i}", "f", rng.choice((3, 4, 5)), "".join(rng.choices("AC", k=rng.randrange(0, 9)))) for i in range(900))
    t = pa.Table.from_pylist([dict(zip([*overlap.EDGE, "ext"], e, strict=True)) for e in edges])
    t = t.set_column(4, "ovl", t.column("ovl").cast(pa.int32()))
    at = np.array([i for i, e in enumerate(edges) if i == 0 or e[:2] != edges[i - 1][:2]])
    assert np.diff(at).max() > 40 > np.diff(at).min()
    order = sorted(range(len(edges)), key=lambda i: (*edges[i][:2], edges[i][5], -edges[i][4]))
    want = np.zeros(len(edges), bool)
    want[order] = list(graph._implied((e[0], e[1], 0, e[5], e[4], e[2], None, None) for e in (edges[i] for i in order)))
    assert (graph._implied_short(t, at) == want).all() and want.any()
