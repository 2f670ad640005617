"""The last seven active days of a key and the label they give, from final daily totals.

A key has one row a day here, so its rows in a window are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stridelake.functions.rules import (
    DAILY_LOW,
    HISTORY_DAYS,
    MICROS,
    WEEK_LOW,
    WEEK_MEDIUM_OR_HIGH,
    WEEK_NONE,
    all_medium_or_high,
)


def last_days(daily: DataFrame, days: int = HISTORY_DAYS) -> DataFrame:
    """The newest `days` active days of each key; `position` 1 is the newest."""
    newest_first = W.partitionBy("key").orderBy(F.desc("day"))
    return (
        daily.withColumn("position", F.row_number().over(newest_first))
        .where(F.col("position") <= days)
        .select("key", "day", "label", "position")
    )


def gaps(daily: DataFrame, days: int = HISTORY_DAYS, target_days: int = 1) -> DataFrame:
    """For each (key, day): the widest step between neighbours among the last `days` active days.

    `continuous` when no step exceeds the target; a single day always is.
    """
    by_day = W.partitionBy("key").orderBy("day")
    # The oldest day of the frame has no neighbour inside it, hence one step less than days.
    steps = by_day.rowsBetween(2 - days, 0)
    return (
        daily.withColumn("step_days", F.date_diff("day", F.lag("day").over(by_day)))
        .withColumn("days_kept", F.count(F.lit(1)).over(by_day.rowsBetween(1 - days, 0)).cast("int"))
        .withColumn("widest_step", F.max("step_days").over(steps))
        .select(
            "key",
            "day",
            "days_kept",
            "widest_step",
            F.coalesce(F.col("widest_step") <= target_days, F.lit(True)).alias("continuous"),
        )
    )


def window_labels(windows: DataFrame, target_seconds: float, kept: int = HISTORY_DAYS) -> DataFrame:
    """The weekly rule for windows of any length: the label of each (key, start) from the last `kept` windows.

    `windows` has one row for each key and window: `key`, `start` (a time), `label` (the daily one). Windows are
    continuous when no step between neighbours is longer than the target, so shorter steps are continuous too. Returns
    `widest_seconds` and `continuous` beside the label; a single window has no step and is continuous.
    """
    by_start = W.partitionBy("key").orderBy("start")
    frame, steps = by_start.rowsBetween(1 - kept, 0), by_start.rowsBetween(2 - kept, 0)
    micros = F.unix_micros("start")
    stepped = windows.withColumn("_step", micros - F.lag(micros).over(by_start)).select(
        "key",
        "start",
        F.count(F.lit(1)).over(frame).cast("int").alias("windows_kept"),
        (F.max("_step").over(steps) / MICROS).alias("widest_seconds"),
        F.count_if(F.col("label") == DAILY_LOW).over(frame).alias("_low"),
    )
    continuous = F.coalesce(F.col("widest_seconds") <= target_seconds, F.lit(True))
    label = (
        F.when((F.col("windows_kept") < kept) | ~continuous, WEEK_NONE)
        .when(F.col("_low") == 0, WEEK_MEDIUM_OR_HIGH)
        .otherwise(WEEK_LOW)
    )
    return stepped.select(
        "key", "start", "windows_kept", "widest_seconds", continuous.alias("continuous"), label.alias("window_label")
    )


def week_labels(daily: DataFrame) -> DataFrame:
    """Weekly label of each (key, day) at the end of that day."""
    kept = W.partitionBy("key").orderBy("day").rowsBetween(1 - HISTORY_DAYS, 0)
    days = F.count(F.lit(1)).over(kept)
    span = F.date_diff("day", F.min("day").over(kept))
    low_days = F.count_if(F.col("label") == DAILY_LOW).over(kept)
    return daily.select(
        "key",
        "day",
        F.when((days < HISTORY_DAYS) | (span >= HISTORY_DAYS), WEEK_NONE)
        .when(low_days == 0, WEEK_MEDIUM_OR_HIGH)
        .otherwise(WEEK_LOW)
        .alias("week_label"),
    )


def all_match(kept: DataFrame) -> DataFrame:
    """For each key: how many days are kept and whether all of them are medium or high.

    `kept` comes from `last_days`, so a collection has seven labels at most.
    """
    return (
        kept.groupBy("key")
        .agg(F.collect_list("label").alias("_labels"))
        .select(
            "key",
            F.size("_labels").alias("days_kept"),
            all_medium_or_high(F.col("_labels")).alias("all_medium_or_high"),
        )
    )
