from helixframe.operators.reads import read_dedup, read_filter
from helixframe.streaming.ingest import collapse_stream, nodes


def test_batches_give_what_one_batch_gives(spark, tmp_path):
    rows = [(f"r{i}", s) for i, s in enumerate(["AACCGGTA", "TACCGGTT", "AACCGGTA", "ACGNACGT", "ACG", "GGGTTTAA"] * 3)]
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame(rows[6 * i : 6 * i + 6], "read_id string, seq string").coalesce(1).write.mode("append").parquet(f"file://{source}")
    stream = spark.readStream.schema("read_id string, seq string").option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    collapse_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state", 5).trigger(availableNow=True).start().awaitTermination()
    want = read_dedup(read_filter(spark.createDataFrame(rows, "read_id string, seq string"), 5))
    assert sorted(map(tuple, nodes(spark, f"file://{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))
