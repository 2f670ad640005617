"""Notifications where the label table and the notification table are given, not the job's own output.

Both are logs of changes with deletes. Nothing the job sends flows back, so the two joins are plain as-of joins and the
debounce compares each candidate with the table alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.functions.rules import DEBOUNCE_SECONDS, gap_exceeds, is_week_active
from stridelake.operators.as_of import as_of
from stridelake.operators.skew import SkewPolicy

RECORD = ["key", "arrival_seq", "userId", "timestamp"]


def join_given_labels(
    activity: DataFrame, labels: DataFrame, time: str = "timestamp", policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """Inner join of activity with the label that its key has at that moment; `labels` has key, change_seq, label and
    the column named by `time`. A key drops out while it has no label, or a deleted one; an empty label is a label."""
    columns = RECORD if time in RECORD else [*RECORD, time]
    return as_of(activity.select(*columns), labels, time, policy=policy).where("label IS NOT NULL").select(*RECORD, "label")


def candidates_with_last(
    activity: DataFrame, labels: DataFrame, sent: DataFrame, policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """Activities that see the active label, each with `sent_at`: the time of its key's notification in the given table
    at that moment (left join: null without one)."""
    wanted = join_given_labels(activity, labels, policy=policy).where(is_week_active(F.col("label")))
    return as_of(wanted.drop("label"), sent, policy=policy)


def far_enough(rows: DataFrame, seconds: int = DEBOUNCE_SECONDS) -> DataFrame:
    """The candidates whose key has no notification, or one far enough away."""
    apart = gap_exceeds(F.unix_micros("timestamp"), F.unix_micros("sent_at"), seconds)
    return rows.where(F.col("sent_at").isNull() | apart)
