"""The reads of documents are cut in batches, as the SQL has them."""

import re

import duckdb

from helixframe import bridge
from helixframe.bridge import ALPHABET, BASES, RAW_SQL, READ_LEN, STEP, raw_reads

TEXTS = [(1, "Zum Beispiel, the Quick brown fox jumps over the lazy dog; and " * 9), (2, None), (3, ""), (4, "é ß 12 ¿"), (5, "z"), (None, "a text without an id, long enough for some reads of it"), (-7, "ÄbcÖdeİK ſ" * 30), (8, "abcdefg" * 5 + "x"), (9, "Q\n" * 5000)]


def saved(spark, tmp_path, parts):
    spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_reads_are_those_of_the_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bridge, "AT_ONCE", 50)
    d = saved(spark, tmp_path, 3)
    got = sorted((r.read_id or "", r.seq) for r in raw_reads(spark, d).collect())
    want = duckdb.sql(f"WITH documents AS (SELECT * FROM '{d}/documents.parquet/*.parquet'), {RAW_SQL} SELECT coalesce(read_id, ''), seq FROM raw").fetchall()
    assert got == sorted(want) and len(got) > 800


def test_batches_are_cut_together(spark, tmp_path):
    """No expression works on one letter or one window: the plan has a step of its own for batches, and no row for a block."""
    d = saved(spark, tmp_path, 1)
    plan = raw_reads(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "translate" not in plan
    letters = {i: re.sub("[^A-Za-z]", "", t or "").lower().translate(str.maketrans(ALPHABET, BASES)) for i, t in TEXTS}
    assert raw_reads(spark, d).count() == sum(-(-len(s) // STEP) for s in letters.values())
    assert max(len(r.seq) for r in raw_reads(spark, d).collect()) == READ_LEN
