"""Event streams: the audit queue, approvals of uploads, and activity with silences.

Every operator takes a streaming or a static DataFrame, so its result is tested on both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_source(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of the Parquet files under path, at most ``files`` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def audit_queue(events: DataFrame, days: int = 30) -> DataFrame:
    """Events without resends: an event_id is let through once within the watermark, older events are dropped."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    events = events.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return events.withWatermark("created_at", f"{days} days").dropDuplicatesWithinWatermark(["event_id"])


def deliver(events: DataFrame, path: str, checkpoint: str, key: str = "event_id") -> StreamingQuery:
    """Appends micro-batches to a Parquet table. A repeated batch id overwrites its own folder, so a resend changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def approved_uploads(uploads: DataFrame, approvals: DataFrame, minutes: int = 10) -> DataFrame:
    """upload_id, at, size of uploads that an approval of the same session covers: at most ``minutes`` old and at least as large.

    A stream-stream interval join; the watermarks bound the state to the interval.
    """
    if uploads.isStreaming:
        uploads = uploads.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", "1 minute")
        approvals = approvals.withColumn("approved_at", F.col("approved_at").cast("timestamp")).withWatermark("approved_at", "1 minute")
    u, a = uploads.alias("u"), approvals.alias("a")
    fits = (
        (F.col("u.session") == F.col("a.session")) & (F.col("a.approved_at") <= F.col("u.at"))
        & (F.col("a.approved_at") > F.col("u.at") - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("a.size") >= F.col("u.size"))
    )
    return u.join(a, fits).select("u.upload_id", "u.at", "u.size")


def sessions(events: DataFrame, by: str, time: str, seconds: int = 45) -> DataFrame:
    """Activity without a silence of ``seconds``; on a stream a session is final once the watermark passes it."""
    if events.isStreaming:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, f"{seconds} seconds")
    grouped = events.groupBy(by, F.session_window(time, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_stop"), "n")


def windowed(events: DataFrame, time: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts by event_type."""
    if events.isStreaming:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n")


def activity(events: DataFrame, by: str = "tab") -> DataFrame:
    """Running count of each tab since its last navigation, shown as '99+' beyond 99; static tables."""
    from pyspark.sql import Window as W

    order = W.partitionBy(by).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    life = F.sum(F.when(F.col("event_type") == "navigate", 1).otherwise(0)).over(order)
    told = events.withColumn("life", life)
    n = F.sum(F.when(F.col("event_type") == "navigate", 0).otherwise(1)).over(W.partitionBy(by, "life").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return told.withColumn("n", n).withColumn("badge", F.when(F.col("n") > 99, "99+").otherwise(F.col("n").cast("string"))).drop("life")


def paired_uploads(events: DataFrame, minutes: int = 10) -> DataFrame:
    """upload_id, began, finished: begin and finish events of an upload, paired within the interval."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 minute")
    begun = events.filter("event_type = 'begin'").select(F.col("upload_id").alias("b_id"), F.col("ts").alias("began"))
    ended = events.filter("event_type = 'finish'").select("upload_id", F.col("ts").alias("finished"))
    fits = (F.col("b_id") == F.col("upload_id")) & (F.col("finished") >= F.col("began")) & (F.col("finished") <= F.col("began") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return begun.join(ended, fits).select("upload_id", "began", "finished")


def latest_per_key(events: DataFrame, key: str, time: str) -> DataFrame:
    """The newest event of each key; on a stream the state is one row a key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), time).alias("e")).select(key, "e.*")
