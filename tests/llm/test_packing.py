import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from helixframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, docs, tokenizer, size):
    """Each id in one piece, checksums right, sequences gapless; the share of padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pad = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        pad += 0 if at & (at - 1) == 0 else size - at
    return pad / (pad + sum(r.length for r in rows))


CASES = [
    (0, None), (1, ""), (2, "Hello  World"), (3, "a\x1cb \x85 c\xa0d"), (4, "ΑΣ ΑΣΑ İstanbul"), (5, "x <|endoftext|> y<|startoftext|>"), (6, "é é Å"),
    (7, "it's we'll 12345 %%%***"), (8, "word " * 5000), (9, "漢字 かな 😀"), (10, " \n\t "), (11, "Ωmega ǅ ß"), (12, "x" * 30000),
]


@pytest.mark.parametrize("windows,min_cut,parts", [(1, 1, 1), (2, 16, 5), (64, 16, 3)])
def test_round_trip(spark, tokenizer, windows, min_cut, parts):
    df = spark.createDataFrame([(d, t, 5) for d, t in CASES], "doc_id long, text string, ids int").repartition(parts)
    rows = packing.pack(df, PATH, size=64, windows=windows, min_cut=min_cut).collect()
    check(rows, CASES, tokenizer, 64)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_query_has_little_padding(spark, tokenizer):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.op2_packing(spark, d).withColumnRenamed("doc_id", "doc").collect()
    assert check(rows, docs, tokenizer, 2048) < 0.03


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, PATH).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted(r.length for r in packing.pack(twice, PATH).collect()) == [1, 3, 3]


def test_a_worker_stays_small_on_new_words():
    code = f"""
import random, resource
from helixframe.llm.packing import groups, word_encoder
import pyarrow as pa
rng = random.Random(1)
column = pa.array([" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(3000)) for _ in range(256)])
encode = word_encoder({PATH!r})
for _, group in groups(column):
    encode(group)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2], timeout=300)
    assert int(done.stdout) < 275


def test_long_texts_and_full_tables_give_the_same_ids(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "KNOWN_BYTES", 2000)
    monkeypatch.setattr(packing, "LEARN_BYTES", 50)
    monkeypatch.setattr(packing, "GROUP_WORDS", 7)
    encode = packing.word_encoder(PATH)
    for _ in range(2):
        for (_, t), ids in zip(CASES, encode([t or "" for _, t in CASES]), strict=True):
            assert ids.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
    column = pa.array(["ab", None, "c" * 900, "", "d"] * 3)
    monkeypatch.setattr(packing, "GROUP_BYTES", 8)
    assert [t for _, g in packing.groups(column) for t in g] == [x or "" for x in column.to_pylist()]
    assert all(len(g) == 1 or sum(map(len, g)) <= 8 for _, g in packing.groups(column))
