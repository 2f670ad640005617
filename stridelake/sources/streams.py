"""Where record streams come from and go to: file folders everywhere, Kafka where its connector is deployed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Topic names.
IOS_TOPIC = "user-activity-ios"
ANDROID_TOPIC = "user-activity-android"
NORMALIZED_TOPIC = "user-activity-normalized"
LABEL_TOPIC = "user-steps-7-days-aggregated"
NOTIFICATION_TABLE_TOPIC = "user-notification-id-table"
NOTIFICATION_TOPIC = "user-notifications"

FEED = "key string, partition_id int, arrival_seq bigint, value string"

# Bounds of one micro-batch, and with it of what one batch holds of any single key.
FILES_PER_BATCH = 256
RECORDS_PER_BATCH = 5_000_000


def files(
    spark: SparkSession,
    path: str,
    schema: str = FEED,
    form: str = "parquet",
    files_per_batch: int | None = FILES_PER_BATCH,
) -> DataFrame:
    """Stream of the files in a folder, which have to land in arrival order.

    With None all files that are there make one micro-batch, inside which the order of files does not matter: the way
    to run a finished table through a stream. Otherwise records that a later file brings behind their key's newest
    are set aside by the keyed operator, see `streaming.stateful`.
    """
    reader = spark.readStream.schema(schema).format(form)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def kafka(
    spark: SparkSession, servers: str, topic: str, records_per_batch: int = RECORDS_PER_BATCH, stream: bool = True
) -> DataFrame:
    """A topic under the feed layout; partition and offset are the arrival order."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", "earliest")
    if stream:
        reader = reader.option("maxOffsetsPerTrigger", records_per_batch)
    return reader.load().select(
        F.col("key").cast("string").alias("key"),
        F.col("partition").alias("partition_id"),
        F.col("offset").alias("arrival_seq"),
        F.col("value").cast("string").alias("value"),
    )


def to_kafka(records: DataFrame, servers: str, topic: str):
    """Writer of (key, value) rows to a topic, for `foreachBatch` and batch jobs."""
    return (
        records.select("key", "value")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
    )
