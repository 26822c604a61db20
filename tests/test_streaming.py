from pyspark.sql import functions as F

from lexloom.streaming.incremental import session_counts, stage_metrics, stream_table, upsert_stream


def test_upsert_stream_resumes_and_keeps_one_row_per_key(spark, tmp_path):
    source, target, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    schema = "k string, v string, w string, t int"
    spark.createDataFrame([("a", "1", None, 1), ("a", "2", None, 2), ("b", "1", "x", 1), (None, "z", "z", 9)], schema).coalesce(1).write.mode("append").parquet(source)
    upsert_stream(stream_table(spark, source, schema), target, "k", "t", ckpt).awaitTermination(60)
    spark.createDataFrame([("a", None, "y", 3), ("c", "3", None, 1)], schema).coalesce(1).write.mode("append").parquet(source)
    upsert_stream(stream_table(spark, source, schema), target, "k", "t", ckpt).awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(target).select("k", "v", "w").collect()} == {("a", "2", "y"), ("b", "1", "x"), ("c", "3", None)}


def test_sessions_and_metrics_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = stream_table(spark, str(tmp_path / "events"), events.schema)
    for name, make in (("s", session_counts), ("m", stage_metrics)):
        q = make(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(90)
        got = {tuple(r) for r in spark.table(f"out_{name}").collect()}
        assert got and got <= {tuple(r) for r in make(events).collect()}
