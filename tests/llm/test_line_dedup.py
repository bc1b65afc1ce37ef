import hashlib
import re
from collections import Counter

from helixframe.llm import line_dedup


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(docs, min_docs, min_chars=1):
    split = [(t or "").split("\n") for _, t in docs]
    seen = Counter(k for ls in split for k in {key(x) for x in ls} if len(k) >= min_chars)
    return [(i, len(ls), "\n".join(kept), len(ls) - len(kept)) for (i, _), ls in zip(docs, split) for kept in [[x for x in ls if seen[key(x)] < min_docs or len(key(x)) < min_chars]]]


DOCS = [(1, "a\nB \n\nc"), (2, " b\nx\r\na"), (3, None), (4, ""), (5, "\t\x0bA\x0c"), (6, "é\nÉ\n\xa0b"), (7, "x\nx\nx"), (7, "x\nx\nx"), (None, "a\né"), (8, "q\n" * 3000 + "a"), (9, "\x1ca")]


def test_brute_force(spark):
    df = spark.createDataFrame([(i, t, "old") for i, t in DOCS], "doc_id long, text string, n_lines string").repartition(3)
    for min_docs, min_chars in ((2, 1), (3, 1), (1, 1), (2, 2), (99, 1)):
        got = [(r.doc_id, r.n_lines, r.text or "", r.n_dropped) for r in line_dedup.drop_common_lines(df, min_docs=min_docs, min_chars=min_chars).collect()]
        assert sorted(got, key=repr) == sorted(brute(DOCS, min_docs, min_chars), key=repr)
    assert line_dedup.drop_common_lines(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op9_line_dedup(spark, d).collect()}
    assert got == {i: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, t, gone in brute(docs, 10)}
