import hashlib
import random

import duckdb
import numpy as np
import pytest

from helixframe.llm import suffix_dedup as S


def brute(docs, length):
    """(id, bytes, removed, runs, kept) of each document, in the order of ids."""
    seen, out = set(), {}
    for i, th, t in sorted(docs):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        runs = int(np.sum(gone & ~np.concatenate(([False], gone[:-1])))) if len(t) else 0
        out[i, th] = (len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


def test_suffix_order(tmp_path):
    rng = random.Random(1)
    for case in range(60):
        parts = ["".join(rng.choices("ab" if case % 2 else "abcd", k=rng.randint(1, 40))).encode() for _ in range(rng.randint(1, 12))]
        text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        symbol = text.astype(int) + 1000
        symbol[ends] = np.arange(len(ends))
        want = [i for i in sorted(range(len(text)), key=lambda i: symbol[i:].tolist()) if i not in set(ends.tolist())]
        common = []
        for i, j in zip(want, want[1:]):
            x, y = symbol[i:].tolist(), symbol[j:].tolist()
            common.append(next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))))
        for held, cap in ((1 << 20, 255), (8, 255), (8, 6), (64, 1)):
            got = [(i, n) for at, shared in list(S.suffixes(text, ends, cap, held, str(tmp_path)))[-2::-1] for i, n in zip(at.tolist(), shared.tolist(), strict=True)]
            assert [i for i, _ in got] == want
            assert [n for _, n in got][1:] == [min(n, cap) for n in common]


def test_queues_of_a_shard_go_to_disk_at_query_defaults(monkeypatch):
    """A shard of ordinary size outgrows what its queues hold; the result is that of a queue in memory."""
    spilled = []
    spill = S.Queue._spill
    monkeypatch.setattr(S.Queue, "_spill", lambda self: (spill(self), spilled.append(self.spilled)))
    rng = np.random.default_rng(3)
    base = [rng.integers(97, 101, 160, dtype=np.uint8).tobytes() for _ in range(9000)]
    parts = [b[k % 60 :] + base[k - 1] for k, b in enumerate(base)] + [b[20:140] for b in base[:4000]]
    rank, start = np.arange(len(parts)), np.zeros(len(parts), np.int64)
    assert S.HELD < sum(map(len, parts)) < S.SHARD
    got = list(S.repeated_windows(parts, rank, start, 100))
    assert spilled
    assert got == list(S.repeated_windows(parts, rank, start, 100, held=1 << 40))
    seen, want = set(), []
    for k, p in enumerate(parts):
        for i in range(len(p) - 99):
            if p[i : i + 100] in seen:
                want.append((k, i))
            seen.add(p[i : i + 100])
    assert [(k, i + j) for k, i, n in got for j in range(n)] == want


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    mixed, base = S._mix(), rng.integers(97, 101, 500, dtype=np.uint8).tobytes()
    a, b = b"x" * 77 + base, base[100:400] + b"yy"
    chosen = []
    for t in (a, b):
        got = {}
        for h, s, w in S.segments(t, 100, mixed):
            for k in range(s, s + w):
                got.setdefault(t[k : k + 100], set()).add(h)
        assert len(got) > 0 and all(len(v) == 1 for v in got.values())
        chosen.append(got)
    both = set(chosen[0]) & set(chosen[1])
    assert len(both) == 201 and all(chosen[0][w] == chosen[1][w] for w in both)


def corpus(rng, n):
    pool = [bytes(rng.choices(b"abcdefgh ", k=rng.choice([30, 60, 200]))) for _ in range(12)]
    out = []
    for _ in range(n):
        t = b"".join(rng.choice(pool) if rng.random() < 0.6 else bytes(rng.choices(b"abcdefgh ", k=rng.randint(0, 50))) for _ in range(rng.randint(0, 8)))
        if out and rng.random() < 0.3:
            t = bytearray(rng.choice(out))
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(b"abz")
            t = bytes(t)
        out.append(t)
    return [*out, b"", b"q" * 700, b"q" * 120, b"ab" * 90]


@pytest.mark.parametrize("length,shard,held,crowd", [(100, 6 << 20, 32 << 20, 100_000), (40, 3000, 64, 100_000), (40, 3000, 64, 3)])
def test_brute_force(spark, length, shard, held, crowd):
    docs = [(i, t.decode()) for i, t in enumerate(corpus(random.Random(length), 120))]
    df = spark.createDataFrame([(i, t, "old") for i, t in docs], "doc_id long, text string, n_spans string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.text)) for r in S.remove_repeats(df, length=length, shard=shard, held=held, crowd=crowd).collect()}
    want = brute([(i, 0, t.encode()) for i, t in docs], length)
    assert got == {i: v for (i, _), v in want.items()}
    assert sum(v[1] for v in got.values()) > 1000


def test_edge_cases(spark):
    t = "é" * 60
    rows = [(None, t), (1, t), (2, None), (2, ""), (3, t[:49]), (4, t + "x"), (5, "z" * 99), (5, "z" * 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(df).collect()]
    by = {(i, n): (gone, spans) for i, n, gone, spans in got}
    assert by[1, 120] == (120, 1) and by[4, 121] == (120, 1) and by[3, 98] == (0, 0) and by[5, 99] == (0, 0) and by[2, 0] == (0, 0)
    twice = spark.createDataFrame([(1, "abc" + t), (1, "abc" + t)], "doc_id long, text string")
    one = spark.createDataFrame([(1, "abc" + t)], "doc_id long, text string")
    assert {tuple(r) for r in S.remove_repeats(twice).collect()} == {tuple(r) for r in S.remove_repeats(one).collect()}
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, 0, r.text.encode()) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for (i, _), v in brute(docs, 100).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op3_suffix_dedup(spark, d).collect()}
    assert got == want


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet' UNION ALL SELECT 10000000, NULL, 'en', 'x', 0 UNION ALL SELECT 10000001, repeat('é', 150), 'en', 'x', 150")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10000000, None), (10000001, "é" * 150)], "doc_id long, text string"))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.text).hexdigest()) for r in S.remove_repeats(docs).collect())
    assert got == sorted(db.execute(S.OP3_SQL).fetchall())


def test_text_of_more_windows_than_a_block(spark):
    """Repeats within a text that is chosen from in two blocks, across the edge of these and of another document."""
    rng = random.Random(11)
    text = "".join(rng.choices("abcdefgh", k=S.BLOCK + 3000))
    # Marks that the text doesn't have stand beside the copies, so that none reaches further by chance.
    long = text[:-2000] + "X" + text[S.BLOCK - 300 : S.BLOCK + 400] + "Y" + text[-2000:] + "Z" + text[5000:5150]
    docs = [(1, long), (2, "x" + text[S.BLOCK - 150 : S.BLOCK + 20] + "y"), (3, text[:99])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.text)) for r in S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: v for (i, _), v in brute([(i, 0, t.encode()) for i, t in docs], 100).items()}
    assert got[1][1] == 700 + 150 and got[2][1] == 170


def test_an_anchor_of_many_segments(spark):
    """One phrase in very many contexts: its anchor is split by the bytes around it, and again by whole windows."""
    rng = random.Random(12)
    phrase = "the same thirty-two or more bytes in every text of all"
    around = ["".join(rng.choices("abcdefgh", k=120)) for _ in range(60)]
    docs = [(i, rng.choice(around) + phrase + rng.choice(around)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = {i: v for (i, _), v in brute([(i, 0, t.encode()) for i, t in docs], 100).items()}
    for crowd in (2000, 40, 5, 1):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.text)) for r in S.remove_repeats(df, crowd=crowd).collect()}
        assert got == want
