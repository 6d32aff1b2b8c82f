from wavemill.streaming import blocks


def test_running_moments(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, value double").write.parquet(source)
    stream = spark.readStream.schema("k string, value double").parquet(source)
    q = blocks.running_moments(stream, "k", "value").writeStream.outputMode("update").format("memory").queryName("moments").option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.k: (r.n, r["mean"], r.m2) for r in spark.table("moments").collect()}
    assert got == {"a": (2, 2.0, 2.0), "b": (1, 5.0, 0.0)}


def test_sliding_counts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("SELECT timestamp'2024-01-01 00:00:03' AS t, 'a' AS k, 2.0D AS value").write.parquet(source)
    stream = spark.readStream.schema("t timestamp, k string, value double").parquet(source)
    q = blocks.sliding_counts(stream, "t", ["k"], "4 seconds", "2 seconds", "1 second").writeStream.outputMode("complete").format("memory").queryName("slides").option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("slides").count() == 2
