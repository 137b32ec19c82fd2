from pyspark.sql import functions as F

from talweg.streaming import streams


def events(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 01:00:00", 2), ("a", "2024-01-02 12:00:00", 3), ("b", "2024-01-01 05:00:00", 4), ("z", "2024-02-01 00:00:00", 5)]
    df = spark.createDataFrame(rows, "k string, ts string, id int").withColumn("ts", F.to_timestamp("ts"))
    df.write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(tuple(r) for r in df.sparkSession.table(name).collect())


def test_windows_sessions_and_first_requests(spark, tmp_path):
    got = run(streams.counts_per_window(events(spark, tmp_path), "ts", ["k"]), tmp_path, "per_window")
    assert [(k, n) for _, k, n in got] == [("a", 2), ("b", 1), ("a", 1)]
    got = run(streams.sessions(events(spark, tmp_path), "ts", "k"), tmp_path, "per_session")
    assert [(k, n) for k, _, _, n in got] == [("a", 2), ("a", 1), ("b", 1)]
    assert len(run(streams.first_requests(events(spark, tmp_path), "ts", ["k"], "40 days"), tmp_path, "first_seen")) == 3


def test_keyed_overwrite(spark, tmp_path):
    q = streams.keyed_overwrite(events(spark, tmp_path), str(tmp_path / "out"), ["id"], str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "batch=0")).count() == 5
