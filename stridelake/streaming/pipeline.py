"""The job as streaming queries: one stateless, one keyed, one for delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from stridelake.functions.rules import day_of
from stridelake.operators.daily import daily_steps_stream, observed
from stridelake.operators.normalize import merge, normalize_android, normalize_ios
from stridelake.plans.pipeline import Settings
from stridelake.schemas import NOTIFICATION_ROW
from stridelake.sources.activity_json import (
    accepted,
    decode_android,
    decode_ios,
    decode_normalized,
    encode_normalized,
)
from stridelake.sources.streams import FEED, files
from stridelake.streaming import sinks
from stridelake.streaming.metrics import rows_dropped
from stridelake.streaming.sinks import write_batch, write_changes, write_checked
from stridelake.streaming.stateful import changes, stream_settings


#: How far behind the newest one a notification can come again and is still known.
REPEATED_WITHIN = "30 days"


def normalized(ios_feed: DataFrame, android_feed: DataFrame, strict: bool = False) -> DataFrame:
    """Both platform feeds as one stream of normalized activity."""
    ios = normalize_ios(accepted(decode_ios(ios_feed, strict)))
    android = normalize_android(accepted(decode_android(android_feed, strict)))
    return merge(ios, android)


def checked(ios_feed: DataFrame, android_feed: DataFrame, strict: bool = False) -> DataFrame:
    """Both feeds as one stream with the text and the fault of each record, decoded once."""
    keep = ("value", "fault")
    return merge(
        normalize_ios(decode_ios(ios_feed, strict), keep), normalize_android(decode_android(android_feed, strict), keep)
    )


def start_ingest(
    ios_feed: DataFrame, android_feed: DataFrame, base: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Write good records as normalized documents and the others, with text and fault, to the quarantine table."""
    writer = checked(ios_feed, android_feed).writeStream.foreachBatch(write_checked(base))
    return _start(writer, checkpoint, once)


def run_job(ios_feed: DataFrame, android_feed: DataFrame, base: str, settings: Settings = Settings()) -> None:
    """The whole job over what the feeds hold now: ingest, changes, delivery, each until its input is used up.

    Run again, it goes on from where it stopped. Tables and checkpoints are folders under `base`, the delivered
    notifications in `base/outbox`. What a run has to read is one micro-batch of each query.
    """
    spark = ios_feed.sparkSession

    def table(name: str, schema: str) -> DataFrame:
        return files(spark, f"{base}/{name}/*", schema, files_per_batch=None)

    start_ingest(ios_feed, android_feed, base, f"{base}/_ingest", once=True).awaitTermination()
    activity = decode_normalized(table(sinks.NORMALIZED, FEED))
    start_changes(activity, base, f"{base}/_changes", settings, once=True).awaitTermination()
    sent = table(sinks.NOTIFICATIONS, NOTIFICATION_ROW)
    delivery = start_delivery(sent, f"{base}/outbox", f"{base}/_delivery", once=True)
    delivery.awaitTermination()
    if rows_dropped(delivery):
        raise RuntimeError(f"{rows_dropped(delivery)} notifications came too late to tell whether they had been sent")


def start_normalization(activity: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the normalized stream as JSON documents in the feed layout."""
    writer = encode_normalized(activity).writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer, checkpoint, once)


def start_daily(activity: DataFrame, base: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Daily totals as a streaming aggregate: a row for each day changed in a micro-batch."""
    totals = observed(daily_steps_stream(activity), "daily_steps")

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, base, "daily_totals", batch_id)

    return _start(totals.writeStream.outputMode("update").foreachBatch(write), checkpoint, once)


def start_changes(
    activity: DataFrame,
    base: str,
    checkpoint: str,
    settings: Settings = Settings(),
    idle_days: int | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Labels, daily totals and notifications from the keyed operator."""
    rows = changes(activity, settings.grace_seconds, settings.debounce_seconds, settings.fresh_label, idle_days)
    writer = rows.writeStream.outputMode("append").foreachBatch(write_changes(base, settings.unique_ids))
    with stream_settings(activity.sparkSession):
        return _start(writer, checkpoint, once)


def delivered_once(notifications: DataFrame, within: str = REPEATED_WITHIN) -> DataFrame:
    """The stream with each notification once, known by its key and offset, and its UTC day.

    What has passed is state of the query, so nothing that was delivered is read again. It is forgotten when it lies
    `within` behind the newest one; rows that come later than that are left out and counted (`metrics.rows_dropped`).
    """
    known = notifications.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(["key", "arrival_seq"])
    return known.withColumn("day", day_of(F.col("timestamp")))


def start_delivery(
    notifications: DataFrame, outbox: str, checkpoint: str, once: bool = False, within: str = REPEATED_WITHIN
) -> StreamingQuery:
    """Append each notification to the outbox once, by day."""
    writer = delivered_once(notifications, within).writeStream.format("parquet").outputMode("append")
    return _start(writer.partitionBy("day").option("path", outbox), checkpoint, once)


def _start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
