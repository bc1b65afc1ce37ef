"""Whitening against numpy on all rows at once, and its handling of rows that can't take part."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from helixframe.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, deviation string"


def plain(vectors, most=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(1), c @ axes / np.sqrt(values), values / np.trace(v)


def test_query_is_numpys(spark):
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pylist()
    n, deviation, white, share = plain([r["embedding"] for r in t])
    got = {}
    for r in W.op12_whitening(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.vec_id, []).append(r)
    assert len(got) == n
    signs = None
    for i, r in enumerate(t):
        rows = sorted(got[r["vec_id"]], key=lambda r: r.component)
        assert [x.component for x in rows] == list(range(1, 33))
        assert {(x.n, x.deviation) for x in rows} == {(n, deviation[i])}
        mine = np.array([x.whitened for x in rows])
        signs = np.sign(mine * white[i]) if signs is None else signs
        assert np.allclose(mine, signs * white[i], atol=1e-8)
        assert np.allclose([x.explained for x in rows], share, rtol=1e-9)
        assert max(x.identity_error for x in rows) < 1e-9


def test_rows_that_are_left_out(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in np.float32(rng.normal(0, 1, 5))], "own") for i in range(200)]
    bad = [(900, None, "a"), (901, [], "a"), (902, [1.0, None, 1.0, 1.0, 1.0], "a"), (903, [float("nan")] * 5, "a"), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0], "a"), (905, [1.0, 2.0], "a")]
    twice = [good[0], (None, good[1][1], "b")]
    df = spark.createDataFrame(good + bad + twice, SCHEMA).withColumn("x", F.lit("x")).repartition(7)
    out, model, error = W.whiten(df, "embedding", 3)
    got = out.collect()
    assert out.columns == ["vec_id", "embedding", "x", "deviation", "whitened"]
    n, deviation, white, _ = plain([v for _, v, _ in good + twice], 3)
    assert len(got) == n == model.n and error < 1e-9 and {len(r.whitened) for r in got} == {3}
    assert sorted(r.deviation for r in got) == sorted(deviation.tolist())
    assert np.allclose(sorted(abs(r.whitened[0]) for r in got), sorted(abs(white[:, 0])), atol=1e-9)


def test_no_rows_and_no_variance(spark):
    for rows in ([], [(1, None, "a")], [(1, [1.0, 2.0], "a")], [(1, [1.0, 2.0], "a")] * 5):
        out, model, error = W.whiten(spark.createDataFrame(rows, SCHEMA), "embedding")
        assert error == 0.0 and [r.whitened for r in out.collect()] == [[] for r in rows if r[1]]
    flat = [(i, [float(i), 2.0 * i, 7.0], "a") for i in range(50)]
    out, model, error = W.whiten(spark.createDataFrame(flat, SCHEMA), "embedding")
    assert len(model.values) == 1 and error < 1e-9 and {len(r.whitened) for r in out.collect()} == {1}


def test_merge_in_any_order():
    """The sums are exact and the scatter is that of all rows, however they are parted; offsets of a million don't cancel."""
    rng = np.random.default_rng(5)
    x = rng.integers(1_000_000, 1_000_100, (3000, 6))
    parts = [W.of_block(p) for p in np.split(x, [1, 50, 51, 700, 2999])]
    left = right = None
    for p in parts:
        left = W.merge(left, p)
    for p in parts[::-1]:
        right = W.merge(p, right)
    c = x - x.mean(0)
    for m in (left, right):
        assert m.n == 3000 and [int(v) for v in m.s] == x.sum(0).tolist()
        assert np.allclose(m.m, c.T @ c, rtol=1e-12, atol=1e-6)
