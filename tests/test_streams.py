"""Streams: buckets that a batch touches, late rows, sessions on a stream and on a table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexmill.streaming import append

T = datetime(2026, 1, 1, 12)


def feed(spark, path, rows, ddl, name):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(ddl).parquet(f"{path}/in")


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    path = str(tmp_path)
    for rows in ([(f"a{i}", 1) for i in range(200)], [("a3", 2), ("new", 2), ("new", 3)]):
        append.append_bucketed(feed(spark, path, rows, "id string, k int", "b"), f"{path}/out", f"{path}/ck", "id", 64).awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    assert out.count() == 201 and out.where("id = 'a3'").first().k == 1
    # a file of another bucket that no reader could open is in nobody's way
    bucket = {r.id: r.id_bucket for r in out.collect()}
    other = next(b for i, b in bucket.items() if b != bucket["a5"])
    (tmp_path / "out" / f"id_bucket={other}" / "part-broken.parquet").write_bytes(b"no parquet")
    append.append_bucketed(feed(spark, path, [("a5", 9)], "id string, k int", "b"), f"{path}/out", f"{path}/ck", "id", 64).awaitTermination()
    assert spark.read.parquet(f"{path}/out/id_bucket={bucket['a5']}").where("id = 'a5'").count() == 1


def test_late_rows_are_kept_beside(spark, tmp_path):
    path, ddl = str(tmp_path), "id int, ts timestamp"
    for rows in ([(1, T), (2, T - timedelta(hours=9)), (3, None)], [(4, T - timedelta(hours=3)), (5, T - timedelta(hours=1)), (6, T + timedelta(hours=5))], [(7, T), (8, T + timedelta(hours=4))]):
        append.route_late(feed(spark, path, rows, ddl, "l"), f"{path}/out", f"{path}/ck").awaitTermination()
    side = lambda s: sorted(r.id for r in spark.read.parquet(f"{path}/out/{s}").collect())
    assert side("late") == [3, 4, 7] and side("rows") == [1, 2, 5, 6, 8]


def test_sessions_on_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = [(u, T + timedelta(minutes=m), 1.0) for u, m in [(1, 0), (1, 29), (1, 58), (1, 88), (1, 119), (2, 5), (2, 5), (2, 50)]]
    ddl, path = "user_id int, ts timestamp, value double", str(tmp_path)
    whole = append.session_counts(spark.createDataFrame(rows, ddl), "user_id")
    want = sorted((r.user_id, r.session_start, r.session_end, r.n) for r in whole.collect())
    at = lambda m: T + timedelta(minutes=m)
    assert want == [(1, at(0), at(118), 4), (1, at(119), at(149), 1), (2, at(5), at(35), 2), (2, at(50), at(80), 1)]
    stream = append.session_counts(feed(spark, path, rows + [(9, T + timedelta(days=1), 0.0)], ddl, "s"), "user_id")
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.user_id, r.session_start, r.session_end, r.n) for r in spark.read.parquet(f"{path}/out").collect()) == want


def test_sliding_windows(spark):
    got = append.sliding_counts(spark.createDataFrame([(T, 1.0), (T + timedelta(minutes=61), 2.0)], "ts timestamp, value double")).collect()
    hour = timedelta(hours=1)
    assert {r.window_start: (r.n, r.total) for r in got} == {T - hour: (1, 1.0), T: (2, 3.0), T + hour: (1, 2.0)}
