import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa

from helixframe.llm import ctph


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_common_length_is_the_table():
    rng = random.Random(5)
    words = ["".join(rng.choices("ABCD", k=rng.choice([0, 1, 5, 63, 64]))) for _ in range(60)]
    a, b = words[:30], words[30:]
    assert ctph.common_length(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b)]


def test_edits_keep_likeness():
    rng = random.Random(1)
    base = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000))
    near = base[:5000] + "INSERTED" + base[5000:]
    far = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000))
    f = [ctph.fingerprint(x.encode()) for x in (base, near, far, "", "a", "short text")]
    assert ctph.likeness([(f[0], f[0]), (f[0], f[1]), (f[0], f[2]), (f[3], f[3]), (f[3], f[4])]).tolist()[::2] == [1, 0, 0]
    assert ctph.likeness([(f[0], f[1])])[0] > 0.9
    assert f[3] == "2::" and f[4] != f[3]
    assert all(len(x.split(":")[1]) <= 64 for x in f)


def plain_fingerprint(text):
    """By the definition, byte after byte and number after number."""
    m32 = 0xFFFFFFFF
    if not text:
        return "2::"

    def number(b):
        x = (b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return x >> 32

    table = [number(b) for b in range(256)]
    strength = {}
    for end in range(8, len(text) + 1):
        r = [table[b] for b in text[end - 8 : end]]
        for factor in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F):
            r = [(a * factor + b) & m32 for a, b in zip(r[::2], r[1::2])]
        x = r[0]
        x ^= x >> 15
        x = x * 0x2C1B3C6D & m32
        x ^= x >> 13
        strength[end] = len(bin(x)) - len(bin(x).rstrip("1"))  # ones at the end

    def ends(k):
        return [e for e, ones in strength.items() if ones >= k]

    def letters(k):
        cuts = ends(k)
        if len(cuts) >= 128:
            cuts = [cuts[i * len(cuts) // 64] for i in range(1, 64)]
        at = [0, *cuts[:63]]
        at += [len(text)] if at[-1] < len(text) else []
        out = ""
        for a, b in zip(at, at[1:]):
            h = zlib.crc32(text[a:b])
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(h ^ h >> 13 ^ h >> 21) % 64]
        return out

    k = max(2, (len(text) // 64).bit_length())
    while k > 2 and len(ends(k)) < 32:
        k -= 1
    return f"{k}:{letters(k)}:{letters(k + 1)}"


def plain_likeness(f, g):
    if f == g:
        return 1.0
    (k, *fs), (m, *gs) = f.split(":"), g.split(":")
    best = 0.0
    for i, a in enumerate(fs):
        for j, b in enumerate(gs):
            if int(k) + i == int(m) + j and a and b:
                n = min(5, max(2, min(len(a), len(b)) // 2))
                if a == b or any(a[x : x + n] in b for x in range(len(a) - n + 1)):
                    best = max(best, 2 * lcs(a, b) / (len(a) + len(b)))
    return best


def test_fingerprints_by_the_definition():
    rng = random.Random(8)
    texts = ["", "a", "short", "eight by", "ninebytes", "é😀" * 9, "x" * 3000, "one passage again. " * 4000, *("".join(rng.choices("abcdef ghij\n", k=rng.randint(1, 9000))) for _ in range(25))]
    prints = [ctph.fingerprint(t.encode()) for t in texts]
    assert prints == [plain_fingerprint(t.encode()) for t in texts]
    pairs = [(rng.choice(prints), rng.choice(prints)) for _ in range(200)]
    near = [(ctph.fingerprint(t.encode()), ctph.fingerprint((t[: len(t) // 2] + "new" + t[len(t) // 2 :]).encode())) for t in texts]
    for p in (pairs, near):
        assert np.allclose(ctph.likeness(p), [plain_likeness(*x) for x in p])


def test_long_periodic_texts_differ_when_half_is_replaced():
    passage, rng = "the same line over and over again, ", random.Random(3)
    whole = passage * 30_000
    half = whole[: len(whole) // 2] + "".join(rng.choices("abcdefgh ", k=len(whole) // 2))
    a, b = ctph.fingerprint(whole.encode()), ctph.fingerprint(half.encode())
    assert len(whole) > 10**6 and ctph.likeness([(a, b)])[0] < 0.9


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: ((r[0] is not None), r[0] or 0, r[1].encode()))
    return [(i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]


def test_next(spark):
    schema = "id long, text string, following string"

    def f(rows):
        a, b, c = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b), pa.array(c)], ["id", "text", "following"])

    rng = random.Random(2)
    big = [(rng.randrange(-500, 500), str(rng.random())) for _ in range(700)] + [(None, "n"), (None, None), (3, "x"), (3, "x")]
    for rows in (big, [(1, "a")], [], [(None, None)], [(7, "b"), (7, "a"), (7, None)]):
        for buckets in (1, 3, 40):
            df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, b int").repartition(5)
            got = [(r.id, r.text, r.following) for r in ctph.with_next(df, f, schema, buckets=buckets).collect()]
            assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: r for r in ctph.op4_fingerprints(spark, d).collect()}
    assert len(got) == len(docs)
    for i, t, n in brute(docs):
        r = got[i]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        if len(t) < 4000:
            assert r.fingerprint == plain_fingerprint(t.encode()) and r.edited_fingerprint == plain_fingerprint(e.encode())
            assert np.isclose(r.near_edited, plain_likeness(r.fingerprint, r.edited_fingerprint)) and np.isclose(r.near_next, plain_likeness(r.fingerprint, ctph.fingerprint(n.encode())))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    edited, following = np.mean([r.near_edited for r in got.values()]), np.mean([r.near_next for r in got.values()])
    print("edited", edited, "next", following)
    assert edited > 0.4 and following < 0.1
