import datetime as dt

from quirework.streaming import ingest


def test_window_counts_by_window_and_key_null_keys_and_repeated_rows_included(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(at(1, 0), "a"), (at(1, 0), "a"), (at(1, 59), "b"), (at(2, 0), "a"), (at(2, 30), None)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(path)
    run = ingest.window_counts(stream).writeStream.format("memory").queryName("window_counts").outputMode("complete").trigger(availableNow=True).start()
    try:
        assert run.awaitTermination(60)
        got = {(str(r.window_start), r.event_type, r.n) for r in spark.table("window_counts").selectExpr("CAST(window_start AS STRING) AS window_start", "event_type", "n").collect()}
    finally:
        run.stop()
        spark.catalog.dropTempView("window_counts")
    assert got == {("2024-01-01 01:00:00", "a", 2), ("2024-01-01 01:00:00", "b", 1), ("2024-01-01 02:00:00", "a", 1), ("2024-01-01 02:00:00", None, 1)}
