"""Steps per key and UTC day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stridelake.functions.rules import DAILY_HIGH, DAILY_LOW, DAILY_MEDIUM, daily_label, day_number, day_of


LABELS = (DAILY_LOW, DAILY_MEDIUM, DAILY_HIGH)


def counted(activity: DataFrame) -> DataFrame:
    """The records that count: those with a key and a time. A missing step count is zero."""
    return activity.where("key IS NOT NULL AND timestamp IS NOT NULL").withColumn(
        "steps", F.coalesce("steps", F.lit(0))
    )


def daily_steps(activity: DataFrame) -> DataFrame:
    """Final total of every (key, day), with the user id of the last record applied.

    Grouped on the record key, not on the user id inside the record. The first step groups on both, so that
    its buffers hold numbers only and hashing does it without sorting; the user id is picked in the second
    step from the few rows left. Partial sums are built before the shuffle, so a hot key reaches its
    reducer as one row a day from each task.
    """
    by_user = (
        counted(activity)
        .groupBy("key", "userId", day_number(F.col("timestamp")).alias("day_no"))
        .agg(F.sum("steps").cast("bigint").alias("steps"), F.max("arrival_seq").alias("_last"))
    )
    return (
        by_user.groupBy("key", "day_no")
        .agg(F.sum("steps").cast("bigint").alias("steps"), F.max_by("userId", "_last").alias("userId"))
        .select(
            "key",
            "userId",
            "steps",
            F.date_from_unix_date("day_no").alias("day"),
            daily_label(F.col("steps")).alias("label"),
        )
    )


def day_totals(activity: DataFrame) -> DataFrame:
    """`daily_steps` without the user id, for what only needs totals and labels: one hash aggregate."""
    return (
        counted(activity)
        .groupBy("key", day_number(F.col("timestamp")).alias("day_no"))
        .agg(F.sum("steps").cast("bigint").alias("steps"))
        .select(
            "key", "steps", F.date_from_unix_date("day_no").alias("day"), daily_label(F.col("steps")).alias("label")
        )
    )


def window_totals(activity: DataFrame, length: str) -> DataFrame:
    """`day_totals` for windows of another length, such as `1 hour`: key, start, steps, label."""
    return (
        counted(activity)
        .groupBy("key", F.window("timestamp", length).alias("_window"))
        .agg(F.sum("steps").cast("bigint").alias("steps"))
        .select("key", F.col("_window.start").alias("start"), "steps", daily_label(F.col("steps")).alias("label"))
    )


def daily_steps_stream(activity: DataFrame, grace: str = "1 hour") -> DataFrame:
    """The same as a streaming aggregate: run it in update mode to get a row for each changed day.

    Lateness follows the watermark of the query: global, and one micro-batch behind.
    """
    window = F.window("timestamp", "1 day")
    return (
        counted(activity)
        .withWatermark("timestamp", grace)
        .groupBy("key", window)
        .agg(
            F.sum("steps").cast("bigint").alias("steps"),
            F.max_by("userId", "arrival_seq").alias("userId"),
        )
        .select(
            "key",
            "userId",
            "steps",
            day_of(F.col("window.start")).alias("day"),
            daily_label(F.col("steps")).alias("label"),
        )
    )


def observed(daily: DataFrame, observation: Observation | str) -> DataFrame:
    """Pass the rows through and count the labels on the way, without a second pass."""
    return daily.observe(
        observation,
        F.count(F.lit(1)).alias("rows"),
        F.sum("steps").alias("steps"),
        *[
            F.count_if(F.col("label") == label).alias(label)
            for label in LABELS
        ],
    )
