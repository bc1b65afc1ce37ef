import hashlib

from helixframe.llm import warc

PAGES = [(i, f"http://h/{i}", f"<p>é {i}</p>\r\n\r\n" * (i % 5)) for i in [*range(0, 130), 5000, 4096 * 300 + 7]]
SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark, tmp_path):
    rows = [*PAGES, (None, None, None), (7, "twice", "x"), (7, "twice", "x")]
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/w")
    got = [tuple(r) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()]
    assert sorted(got, key=repr) == sorted([(i, u or "", h or "") for i, u, h in rows], key=repr)


def test_damage_is_located(spark):
    own = [*PAGES, (None, "n", "m"), (8, "twice", "x"), (8, "twice", "x")]
    hurt = [(i, u, h + "!" if i in (3, 5000) else h) for i, u, h in own if i != 77][:-1] + [(999_999, "new", "")]
    got = {(r.id, r.sha256 is not None, r.replica_sha256 is not None) for r in warc.audit(spark.createDataFrame(own, SCHEMA), spark.createDataFrame(hurt, SCHEMA)).collect()}
    assert got == {(3, True, True), (5000, True, True), (77, True, False), (8, True, False), (999_999, False, True)}


def test_reported_bytes_are_in_the_files(spark, tmp_path):
    """Long bodies, repeats and a key of many records; a byte range read from a written file has the reported hash."""
    own = [*PAGES, (8, "twice", "x"), (8, "twice", "x"), *((60, f"u{i}", "é" * (i % 7)) for i in range(300)), (61, "long", "y" * 3_000_000), (None, "n", "m")]
    hurt = [(i, u, "gone") if i in (61, 129, 5000) or (i == 60 and u in ("u7", "u250")) or u == "n" else (i, u, h) for i, u, h in own]
    schema = SCHEMA + ", k string, sha string, file_no int, n int"
    df, bad = (spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], schema).repartition(4) for rows in (own, hurt))
    warc.write_warc(df, f"file://{tmp_path}/w")
    found = warc.audit(df, bad).filter("sha256 IS NOT NULL").collect()
    assert sum(r.id is not None for r in found) == 6
    for r in found:
        (file,) = (tmp_path / "w" / f"file_no={r.file_no}").glob("*.txt")
        data = file.read_bytes()[r.record_offset : r.record_offset + r.record_length]
        assert data.endswith(b"\r\n\r\n") and hashlib.sha256(data[:-4]).hexdigest() == r.sha256


def test_equal_and_empty(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    none = df.limit(0)
    assert warc.audit(df, df.repartition(5)).count() == 0
    assert warc.audit(none, none).count() == 0
    assert warc.audit(df, none).count() == len(PAGES) == warc.audit(none, df).count()
