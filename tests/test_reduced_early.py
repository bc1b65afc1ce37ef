"""Edges that their part shows to be implied are never written, and sides are exchanged packed."""

import random

import pyarrow as pa
import pytest

from helixframe.operators import graph, overlap
from test_carried import NODES, rows, tiled


def test_parts_leave_implied_edges_out(spark):
    nodes = spark.createDataFrame(tiled(1500, 7), NODES).repartition(3).cache()
    whole = overlap.with_extensions(nodes, 21, high=2000)
    some = overlap.with_extensions(nodes, 21, high=2000, reduce=True)
    kept, every = set(rows(some)), set(rows(whole))
    left = set(rows(graph.transitive_reduction(whole, nodes)))
    assert left <= kept < every and len(kept) < 0.9 * len(every)
    assert set(rows(graph.transitive_reduction(some, nodes))) == left


def test_sides_are_exchanged_packed(spark):
    """Less than 55 bytes for an edge with two ids of 14 letters: rows that are sorted by their side take more."""
    rng = random.Random(5)
    made = [(f"d{rng.randrange(10**6):06}p{rng.randrange(1000):03}_1", "f", f"d{rng.randrange(10**6):06}p{rng.randrange(1000):03}_2", "r", rng.randrange(21, 36), "".join(rng.choices("ACGT", k=7))) for _ in range(60_000)]
    edges = spark.createDataFrame(made, "src string, src_dir string, dst string, dst_dir string, ovl int, ext string").repartition(1).cache()
    assert edges.count() == 60_000
    seen = spark.sparkContext._jsc.sc().statusStore()
    before = seen.executorSummary("driver").totalShuffleWrite()
    assert graph._not_implied(edges).count() > 50_000
    assert seen.executorSummary("driver").totalShuffleWrite() - before < 55 * 60_000


@pytest.mark.parametrize("seed", range(3))
def test_packed_edges_come_back(seed):
    rng = random.Random(seed)
    edges = [(f"s{rng.randrange(10 ** rng.randrange(1, 6))}", rng.choice("fr"), f"dé{i}", rng.choice("fr"), rng.randrange(1, 90_000), "".join(rng.choices("ACGT", k=rng.randrange(0, 40)))) for i in range(500)]
    t = pa.Table.from_pylist([dict(zip(graph.PACKED.names, e, strict=True)) for e in edges], schema=graph.PACKED)
    part = [rng.randrange(7) for _ in edges]
    sent = graph._packed(t.append_column("part", pa.array(part, pa.int32()))).to_pylist()
    assert [x["part"] for x in sent] == sorted(set(part))
    for x in sent:
        back = graph._unpacked([x["data"], x["data"]]).to_pylist()
        assert [tuple(r.values()) for r in back] == 2 * [e for e, p in zip(edges, part, strict=True) if p == x["part"]]
