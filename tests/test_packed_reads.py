"""Reads are exchanged packed, and come back as they were."""

import random

import numpy as np
import pyarrow as pa

from helixframe.operators import reads


def turned_over(t):
    return t.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def some_reads():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ACGT", k=rng.randint(0, 40))) for _ in range(400)] + ["", "A", "T", "AT", "ACGT", "TTTT", "AAAA", "AAA", "AAAAA", None, "ANG", "CNT", "é", "ACGTé"]
    texts += [t and turned_over(t) for t in texts[::3]] + texts[::4]
    return [(None if k == 7 else f"r{rng.randrange(900)}_{k % 2 + 1}", t) for k, t in enumerate(texts)]


def test_packed_texts_come_back():
    texts = [t for _, t in some_reads()]
    keys, turned = reads.pack(pa.array(texts, pa.string()))
    assert reads.unpack(pa.array(keys, pa.binary()), np.array(turned)).to_pylist() == texts
    least = [t if t is None else min(t, turned_over(t), key=str.encode) for t in texts]
    assert turned == [t is not None and a != t for a, t in zip(least, texts, strict=True)]
    assert len(set(keys)) == len(set(least))
    assert max(len(k) for k, t in zip(keys, texts) if t and set(t) <= set("ACGT")) == 11


def test_dedup_is_that_of_whole_texts(spark):
    rows = some_reads() * 2
    want = {}
    for i, t in rows:
        c = None if t is None else min(t, turned_over(t), key=str.encode)
        want.setdefault(c, []).append((i is not None, i or "", t or ""))
    want = sorted((min(x)[1], None if c is None else min(x)[2], float(len(x))) for c, x in want.items())
    for parts in (1, 5):
        got = reads.read_dedup(spark.createDataFrame(rows, "read_id string, seq string").repartition(parts)).collect()
        assert sorted((r.node_id or "", r.seq, r.cov) for r in got) == want


def test_rows_that_are_exchanged_are_small(spark):
    """A read of 36 bases is sent as a key of 10 bytes, and repeated ones once from a task."""
    batch = pa.RecordBatch.from_arrays([pa.array([f"r{k}" for k in range(1000)]), pa.array(["ACGTTGCAACGTTGCAACGTTGCAACGTTGCAAAAA"] * 1000)], ["read_id", "seq"])
    (out,) = reads._combined([batch])
    assert out.num_rows == 1 and len(out.column(0)[0].as_py()) == 10 and out.column(3)[0].as_py() == 1000
