"""Notifications: candidates from the label join, and what is still to be delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.functions.rules import NOTIFICATION_ID, day_of, is_week_active, payload, unique_notification_id


def join_label(timeline: DataFrame) -> DataFrame:
    """Inner join of each activity with the label of its key at that moment: keys without one drop out.

    An empty label is a label. Activities that came too late to count still take part.
    """
    return timeline.where(F.col("label_seen").isNotNull()).select(
        "key", "block", "arrival_seq", "userId", "timestamp", F.col("label_seen").alias("label")
    )


def candidates(joined: DataFrame) -> DataFrame:
    """The activities that see the active label: each asks for a notification."""
    return joined.where(is_week_active(F.col("label"))).drop("label")


def notification_fields(rows: DataFrame, unique_ids: bool = False) -> DataFrame:
    """The notification for each row of `candidates`, or for those the debounce kept.

    The stamp is the time of the activity, not the wall clock, so that a replay gives the same rows.
    The id is the fixed one unless `unique_ids`; the delivery goes by key and offset and needs neither.
    """
    notification_id = (
        unique_notification_id(F.col("key"), F.col("timestamp"), F.col("arrival_seq"))
        if unique_ids
        else F.lit(NOTIFICATION_ID)
    )
    return rows.select(
        "key",
        "arrival_seq",
        "userId",
        notification_id.alias("notificationId"),
        payload(F.col("userId")).alias("payload"),
        "timestamp",
    )


def undelivered(notifications: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """Each notification once, without those already in `delivered` (key, arrival_seq, day).

    A notification is known by its key and the offset of its activity, whatever its id is. A repeated one carries
    the timestamp it had, so one day of the outbox is enough to look for it.
    """
    same = ["key", "arrival_seq"]
    todo = notifications.dropDuplicates(same).withColumn("day", day_of(F.col("timestamp")))
    if delivered is None:
        return todo
    return todo.join(delivered.select(*same, "day"), [*same, "day"], "left_anti")
