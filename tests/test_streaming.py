from setflow import Box, BoxPartition, BoxSet
from setflow.streaming.cover import stream_cover, stream_histogram

P = BoxPartition(Box([0, 0], [1, 1]), [4, 4])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i % 6}:00", (i % 7) / 4 - 0.9, (i % 5) / 3 - 0.8) for i in range(60)]
    df = spark.createDataFrame(rows, "t string, x double, y double").selectExpr("timestamp(t) AS ts", "x", "y")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_histogram(stream, P, ["x", "y"], "ts", "2 minutes", "1 hour").writeStream.format("memory").queryName("hist").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["key"]: r["n"] for r in spark.sql("SELECT key, sum(n) AS n FROM hist GROUP BY key").collect()}
    assert sorted(got) == BoxSet.cover(P, df, ["x", "y"]).keys()
    q = stream_cover(stream, P, ["x", "y"], "ts", "1 hour").writeStream.format("memory").queryName("cells").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["key"] for r in spark.sql("SELECT key FROM cells").collect()) == BoxSet.cover(P, df, ["x", "y"]).keys()
