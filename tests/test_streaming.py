from assayer.streaming import events as live

ROWS = [(1, "2024-01-01 00:00:00", 1, "error"), (2, "2024-01-01 00:10:00", 1, "error"), (2, "2024-01-01 00:10:00", 1, "error"), (3, "2024-01-01 02:00:00", 1, "view"), (4, "2024-01-01 02:05:00", 2, "purchase")]


def static(spark):
    return spark.createDataFrame(ROWS, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "cast(1 as double) value", "'{}' props")


def drained(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_and_table_agree(spark, tmp_path):
    static(spark).write.parquet(f"{tmp_path}/in")
    stream = live.read(spark, f"{tmp_path}/in")
    once = drained(spark, live.first_of_each(stream), "once")
    assert once.count() == live.first_of_each(static(spark)).count() == 4
    counts = drained(spark, live.tumbling_counts(stream), "counts", "complete")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, live.tumbling_counts(static(spark)).collect()))
    targets = {r.user_id: r for r in drained(spark, live.live_targets(stream), "targets", "update").collect()}
    assert targets[1].resolution == "exhausted" and targets[2].resolution == "succeeded"
    assert live.sessions(static(spark)).count() == 3
