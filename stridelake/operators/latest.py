"""Table semantics: the last value of each key in a log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, order: str = "arrival_seq", key: str = "key") -> DataFrame:
    """Last row of each key. Tasks keep one row for each key before the shuffle, however long its log is."""
    values = [name for name in log.columns if name != key]
    return (
        log.groupBy(key)
        .agg(F.max_by(F.struct(*values), order).alias("_last"))
        .select(key, *[F.col(f"_last.{name}").alias(name) for name in values])
    )


def present(rows: DataFrame, key: str = "key", order: str = "arrival_seq") -> DataFrame:
    """Rows of keys that are in the table: a row whose values are all null stands for a deleted key."""
    values = [name for name in rows.columns if name not in (key, order)]
    return rows.where(" OR ".join(f"`{name}` IS NOT NULL" for name in values))


def current_rows(log: DataFrame, order: str = "change_seq", key: str = "key") -> DataFrame:
    """The table that a log of changes with deletes stands for: the last change of each key, unless it deletes it.

    A key can be deleted and come back. Changes without a key belong to no row.
    """
    return present(latest(log.where(F.col(key).isNotNull()), order, key), key, order)


def latest_labels(timeline: DataFrame) -> DataFrame:
    """The compacted label table: current weekly label of every key that has one."""
    changes = timeline.where(F.col("week_label").isNotNull())
    return latest(changes.select("key", "arrival_seq", "week_label"))


def last_notifications(notifications: DataFrame) -> DataFrame:
    """The notification table: last one sent to each key."""
    return latest(notifications.select("key", "arrival_seq", "userId", "notificationId", "payload", "timestamp"))
