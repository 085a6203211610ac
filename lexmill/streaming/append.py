"""Incremental forms: append what the store lacks batch by batch, windowed counts of events, and late rows kept beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Write each record id once, however often it comes: every micro-batch leaves out what the store has.

    A batch that is run again after a failure finds its own rows in the store, so nothing is added twice."""

    def add(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_bucketed(stream: DataFrame, path: str, checkpoint: str, key: str, buckets: int = 1024) -> StreamingQuery:
    """As ``append_new``, into a store with a folder a bucket of the id's hash (column ``id_bucket``).

    A micro-batch reads the ids of the buckets that its own ids fall in, and no other file of the store. More buckets
    make that less: choose about ten times the ids of a usual batch, and at most what the store's listing bears."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("id_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in fresh.select("id_bucket").distinct().collect()]  # buckets at most
        new = fresh
        if exists(spark, path) and touched:
            # the folders are named, so that no other one is listed
            known = [f"{path}/id_bucket={b}" for b in touched if exists(spark, f"{path}/id_bucket={b}")]
            if known:
                new = fresh.join(spark.read.parquet(*known).select(key), key, "left_anti")
        new.repartition("id_bucket").write.mode("append").partitionBy("id_bucket").parquet(path)
        fresh.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def route_late(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", delay: str = "2 hours") -> StreamingQuery:
    """Rows that are in time go to path/rows, late ones to path/late: none is dropped.

    A row is late if it is older than the greatest time of earlier micro-batches less ``delay``, which is what a
    watermark would drop. Each micro-batch writes its own folders and its greatest time anew, so one that runs again
    after a failure replaces what it had written. Rows without a time are late."""

    def split(batch: DataFrame, number: int) -> None:
        spark, marks, batch = batch.sparkSession, f"{path}/marks", batch.persist()
        before = None
        if exists(spark, marks):
            before = spark.read.parquet(marks).where(F.col("batch") < number).agg((F.max("top") - F.expr(f"INTERVAL {delay}"))).first()[0]
        in_time = F.col(ts).isNotNull() if before is None else F.coalesce(F.col(ts) >= F.lit(before), F.lit(False))
        batch.where(in_time).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        batch.where(~in_time).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max(ts).alias("top")).write.mode("overwrite").parquet(f"{marks}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_counts(events: DataFrame, by: str, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Events and their values by session: rows of one key of which each is ``gap`` or less after the one before; on a stream and on a table."""
    out = events.withWatermark(ts, late) if events.isStreaming else events
    kept = out.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return kept.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def sliding_counts(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Events and their values by windows that overlap; the same on a stream and on a table."""
    out = events.withWatermark(ts, late) if events.isStreaming else events
    return out.groupBy(F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "n", "total")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their values by window and type; the same on a stream and on a table."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
