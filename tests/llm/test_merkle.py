"""The manifest against trees made level by level, its SQL, and the traversal's memory."""

import hashlib
import random

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helixframe.llm import merkle as M


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_paths(leaves):
    """(root, a list of (sibling or none, side) for each leaf)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            k = i ^ 1
            p.append((level[k], "R" if k & 1 else "L") if k < len(level) else ("", "-"))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i >> 1 for i in at]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 33, 100, 255, 256])
@pytest.mark.parametrize("step", [1, 2, 3])
def test_traversal(n, step):
    leaves = [h(str(i)) for i in range(n)]
    root, paths = plain_paths(leaves)
    got = list(M.traverse([x.encode() for x in leaves], M.height_of(n), step))
    assert [(s.decode(), d) for s, d in got] == [("".join(x for x, _ in p), "".join(d for _, d in p)) for p in paths]
    assert M.root_of([x.encode() for x in leaves], M.height_of(n)).decode() == root


def test_traversal_holds_few_nodes(monkeypatch):
    held, most = set(), 0
    real = M.Builder

    class Seen(real):
        def __init__(self, *a):
            super().__init__(*a)
            held.add(self)

        def step(self, times):
            nonlocal most
            super().step(times)
            live = sorted(held, key=id)[-20:] if len(held) > 40 else held
            most = max(most, max(len(b.stack) + len(b.nodes) for b in live))

    monkeypatch.setattr(M, "Builder", Seen)
    list(M.traverse([h(str(i)).encode() for i in range(1024)], 10, 2))
    assert most <= 2 + 4 + 11  # of one subtree: its own nodes and the stack above its leaves


def plain_manifest(rows):
    """{(id, leaf): ...} of rows (id, group, digest)."""
    groups = {}
    for i, g, d in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        groups[g].sort()
        made[g] = plain_paths([d for *_, d in groups[g]])
    root, above = plain_paths([made[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (some, i, d), p in zip(groups[g], made[g][1], strict=True):
            whole = p + above[k]
            out.append((i if some else None, g, d, "".join(x for x, _ in whole), "".join(s for _, s in whole), made[g][0], root))
    return sorted(out, key=repr)


def rows_of(sizes, seed=2):
    rng = random.Random(seed)
    ids = rng.sample(range(10**6), sum(sizes.values()))
    return [(ids.pop(), g, h(g or "-", str(i))) for g, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 5, None: 3, "": 2, "b": 1}, {"en": 2100, "de": 1025, "fr": 1024}, {f"g{i}": 1 + i % 3 for i in range(1100)}])
def test_against_plain_trees(spark, sizes):
    rows = rows_of(sizes)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, lang string, d string, g string, root int").repartition(6)
    out = M.manifest(df, digest=F.col("d"), group=F.col("lang"), key=F.col("id"))
    assert out.columns == ["id", "lang", "d", "g", "leaf", "siblings", "sides", "subroot", "root"]
    got = out.withColumn("again", M.folded(F.col("leaf"), F.col("siblings"), F.col("sides"))).collect()
    assert sorted(((r.id, r.lang, r.leaf, r.siblings, r.sides, r.subroot, r.root) for r in got), key=repr) == plain_manifest(rows)
    assert all(r.again == r.root and r.leaf == r.d and r.g == "x" for r in got)


def test_ties_nulls_and_repeats(spark):
    """A third of the rows are alike; ids are missing and repeated."""
    rows = [*rows_of({"a": 1500}), *[(7, "a", h("same"))] * 900, *[(8, "a", h(str(i))) for i in range(300)], (None, None, h("n")), (None, "a", h("m")), (None, "a", h("m"))]
    df = spark.createDataFrame(rows, "id long, lang string, d string").repartition(6)
    got = M.manifest(df, digest=F.col("d"), group=F.col("lang"), key=F.col("id")).collect()
    assert sorted(((r.id, r.lang, r.leaf, r.siblings, r.sides, r.subroot, r.root) for r in got), key=repr) == plain_manifest(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, lang string, d string")
    assert M.manifest(df, digest=F.col("d"), group=F.col("lang"), key=F.col("id")).collect() == []


def test_leaf_of_fields(spark):
    df = spark.createDataFrame([(1, "é" * 100_000, None, ""), (None, None, None, None)], "a long, b string, c long, d string")
    got = [r[0] for r in df.select(M.leaf(*map(F.col, "abcd"))).collect()]
    assert got == [h("1:1", "200000:" + "é" * 100_000, "-", "0:"), h("----")]


def test_query_against_sql(spark, tmp_path):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    rows = t.to_pylist()
    rows += [dict(rows[3], doc_id=5001, lang=None), dict(rows[4], doc_id=5002, n_chars=None), dict(rows[5], doc_id=5003, text=None, source=None), dict(rows[6], doc_id=5004, text="", lang=""), dict(rows[7], doc_id=None)]
    import pyarrow as pa

    pq.write_table(pa.Table.from_pylist(rows, schema=t.schema), tmp_path / "documents.parquet")
    out = M.op13_merkle(spark, str(tmp_path))
    got = [tuple(r) for r in out.collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert sorted(got, key=repr) == sorted(db.execute(f"SELECT {', '.join(out.columns)} FROM ({M.OP13_SQL})").fetchall(), key=repr)
    assert {r[-1] for r in got} == {True, False}
