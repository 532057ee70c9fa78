from pyspark.sql import functions as F

from tessera.streaming import changes, windows

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _write(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(t) ts", "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch(spark, tmp_path):
    path = f"{tmp_path}/in"
    _write(spark, path, [(i, 1_700_000_000 + i * 600, i % 3, "a", 1.0) for i in range(30)])
    stream = spark.readStream.schema(EVENTS).parquet(path)
    q = windows.tumbling(stream, "1 hour", "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = windows.tumbling(spark.read.parquet(path), "1 hour")
    assert sorted(map(tuple, spark.sql("select * from tumbled").collect())) == sorted(map(tuple, batch.collect()))


def test_late_rows_and_sessions(spark, tmp_path):
    path, at = f"{tmp_path}/in", 1_700_000_000
    _write(spark, path, [(1, at, 1, "a", 1.0), (2, at + 60, 1, "a", 1.0), (3, at + 7200, 1, "a", 1.0)])
    q = windows.stream_sessions(spark.readStream.schema(EVENTS).parquet(path), "10 minutes", "10 minutes").writeStream.format("memory").queryName("sess").start()
    q.processAllAvailable()
    _write(spark, path, [(4, at + 120, 1, "a", 1.0), (5, at + 20000, 1, "a", 1.0)])
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.sql("select n from sess order by start").collect()][0] == 2


def test_keep_latest(spark, tmp_path):
    path = f"{tmp_path}/in"
    _write(spark, path, [(1, 1, 7, "a", 1.0), (2, 1, 8, "a", 1.0), (3, 1, 7, "b", 2.0)])
    stream = spark.readStream.schema(EVENTS).parquet(path)
    changes.keep_latest(stream, f"{tmp_path}/state", ["user_id"], "event_id", f"{tmp_path}/ck").awaitTermination()
    _write(spark, path, [(9, 1, 8, "c", 3.0)])
    changes.keep_latest(spark.readStream.schema(EVENTS).parquet(path), f"{tmp_path}/state", ["user_id"], "event_id", f"{tmp_path}/ck").awaitTermination()
    state = changes.latest(spark, f"{tmp_path}/state", stream.schema, 1)
    assert {(r.user_id, r.event_type) for r in state.collect()} == {(7, "b"), (8, "c")}
    assert spark.read.parquet(f"{tmp_path}/state/data/v1").count() == 1  # only what changed is written again


def test_document_changes(spark, tmp_path):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "x")]
    spark.createDataFrame(rows, "doc_id long, version long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, version long, text string").parquet(f"{tmp_path}/in")
    q = changes.document_changes(stream).writeStream.format("memory").queryName("docs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.doc_id, r.version): r.changed for r in spark.sql("select * from docs").collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): True, (2, 1): True}


def test_watch_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bsl").write_text("x")
    q = changes.watch_files(spark, f"{tmp_path}/f", "*.bsl").select(F.col("length")).writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from files").first()[0] == 1
