"""Streams over files, driven to their end."""

import datetime as dt

from pyspark.sql import functions as F

from grafonda.streaming import streams


def test_rate_limit_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(i, "u", t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 20, 65, 70])], "event_id long, user string, ts timestamp")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = streams.rate_limited(s, "user", "ts", "event_id", 2, 60.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["allowed"] for r in spark.sql("select * from limited order by event_id").collect()] == [True, True, False, True, True]


def test_upsert_stream(spark, tmp_path):
    e = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, ts int, v int")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = s.writeStream.foreachBatch(streams.upsert_into(str(tmp_path / "out"), "k", "ts")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out/v0")).collect()) == [("a", 20), ("b", 5)]


def test_gauges(spark, tmp_path):
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), "x", 1.0), (dt.datetime(2024, 1, 1, 0, 50), "x", 2.0), (dt.datetime(2024, 1, 1, 3, 0), "x", 4.0)], "ts timestamp, kind string, value double")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = streams.gauges(s, "ts", "kind", "value").writeStream.format("memory").queryName("gauged").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n"], r["total"]) for r in spark.table("gauged").select("n", F.col("total")).collect()] == [(2, 3.0)]
