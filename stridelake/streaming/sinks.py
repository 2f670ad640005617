"""Writing micro-batches so that a batch run twice leaves one result.

Each sink keeps a log: a folder per table, in it a folder per micro-batch, overwritten when the batch is
repeated. A log read through `operators.latest` is the table of current values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.functions.rules import day_of
from stridelake.operators.latest import latest
from stridelake.operators.notify import notification_fields, undelivered
from stridelake.sources.activity_json import encode_normalized, quarantined

LABELS = "weekly_labels"
DAILY = "daily_steps"
NOTIFICATION_TABLE = "notification_table"
NOTIFICATIONS = "notifications"
CHANGES = "changes"
BEHIND = "behind"
NORMALIZED = "normalized"
QUARANTINE = "quarantine"


def read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table at the path; None while there is no such path. The file system is asked first, since a read that fails
    leaves its trace in the log of each query that runs."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_batch(rows: DataFrame, base: str, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{base}/{table}/batch_id={batch_id}")


def read_log(spark: SparkSession, base: str, table: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{base}/{table}")


def write_checked(base: str):
    """`foreachBatch` function for checked records: good ones as documents, faulty ones to the quarantine."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write_batch(encode_normalized(batch.where("fault IS NULL")), base, NORMALIZED, batch_id)
            write_batch(quarantined(batch), base, QUARANTINE, batch_id)
        finally:
            batch.unpersist()

    return write


def write_changes(base: str, unique_ids: bool = False):
    """`foreachBatch` function for the keyed operator: one pass over its output, several tables.

    Records that came behind later ones of their key are set aside in a table of their own. Labels and daily totals
    are compacted inside the batch before they are written; notifications go to the
    lookup table and downstream.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        everything = batch.persist()
        try:
            batch = everything
            if "behind" in batch.columns:
                write_batch(everything.where("behind"), base, BEHIND, batch_id)
                batch = everything.where("NOT behind").drop("behind")
            write_batch(batch, base, CHANGES, batch_id)
            on_time = batch.where("on_time")
            labels = latest(on_time.select("key", "arrival_seq", "week_label"))
            write_batch(labels, base, LABELS, batch_id)
            days = on_time.groupBy("key", "day").agg(
                F.max_by(F.struct("userId", "steps", F.col("day_label").alias("label")), "arrival_seq").alias("last"),
                F.max("arrival_seq").alias("arrival_seq"),
            )
            write_batch(days.select("key", "day", "last.*", "arrival_seq"), base, DAILY, batch_id)
            notifications = notification_fields(batch.where("notified"), unique_ids)
            write_batch(notifications, base, NOTIFICATION_TABLE, batch_id)
            write_batch(notifications, base, NOTIFICATIONS, batch_id)
        finally:
            everything.unpersist()

    return write


def compact(spark: SparkSession, base: str, table: str, key: str = "key") -> int | None:
    """Reduce the log of a table to the last row of each key, as of its newest batch.

    Writes a folder of its own and leaves the log as it is; folders of batches up to the returned number are
    no longer read by `current` and may be removed by whoever looks after the storage.
    """
    newest = read_log(spark, base, table).agg(F.max("batch_id")).first()[0]
    if newest is None:
        return None
    rows = current(spark, base, table, key)
    rows.write.mode("overwrite").parquet(f"{base}/{table}_compacted/upto={newest}")
    return newest


def current(spark: SparkSession, base: str, table: str, key: str = "key") -> DataFrame:
    """Last row of each key: the newest compaction and the batches since."""
    log = read_log(spark, base, table)
    compacted = read_if_there(spark, f"{base}/{table}_compacted")
    if compacted is None:
        return latest(log.drop("batch_id"), key=key)
    upto = compacted.agg(F.max("upto")).first()[0]
    newer = log.where(F.col("batch_id") > upto).drop("batch_id")
    return latest(compacted.where(F.col("upto") == upto).drop("upto").unionByName(newer), key=key)


def deliver_to(outbox: str):
    """`foreachBatch` function that appends what the outbox does not hold yet, by key and offset.

    The outbox is partitioned by day, and a repeated one has the day it had, so only the days between the
    first and the last of the batch are read. Repeating a batch finds its own rows and appends nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        day = day_of(F.col("timestamp"))
        first, last = batch.agg(F.min(day), F.max(day)).first()
        if first is None:
            return
        delivered = read_if_there(batch.sparkSession, outbox, "key string, arrival_seq bigint, day date")
        if delivered is not None:
            delivered = delivered.where(F.col("day").between(F.lit(first), F.lit(last)))
        undelivered(batch, delivered).write.mode("append").partitionBy("day").parquet(outbox)

    return write
