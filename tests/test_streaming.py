from pyspark.sql import functions as F

from quoin.streaming.windows import read_stream, window_reductions


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = window_reductions(read_stream(spark, str(tmp_path / "in"), events.schema), "ts", "value", "1 day", "3650 days", ["event_type"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("reductions").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        got = spark.table("reductions").select("start", "event_type", "n", F.round("sum", 6)).collect()
    finally:
        q.stop()
    want = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*"), F.round(F.sum("value"), 6)).select("w.start", "event_type", "count(1)", "round(sum(value), 6)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
