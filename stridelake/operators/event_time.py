"""Event time, stream time and the grace period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stridelake.functions.rules import GRACE_SECONDS, day_number
from stridelake.operators.skew import SkewPolicy, running_max
from stridelake.session import staged

DAY_SECONDS = 86_400


def with_event_time(rows: DataFrame, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Add `event_time` and `stream_time` to records whose body, and so `timestamp`, may be missing.

    Stream time is the highest event time seen in the source partition so far. A record without a body
    takes it as its event time; before the first body there is none and both stay null.
    """
    clocked = running_max(rows, "partition_id", F.col("timestamp"), policy)
    return clocked.withColumn("event_time", F.coalesce("timestamp", "running_max")).withColumnRenamed(
        "running_max", "stream_time"
    )


def day_closings(rows: DataFrame, grace_seconds: int = GRACE_SECONDS) -> DataFrame:
    """(partition_id, day_no, closed_by): offset of the record whose event time ends the day's grace.

    A day is closed by the first record of its partition stamped at or after day end + grace: one of the
    day right behind the grace that is far enough into its day, or any of a later day. First offsets per
    day tell both, so the rows are aggregated and never ordered. One row for each partition and UTC day.
    """
    whole_days, rest = divmod(grace_seconds, DAY_SECONDS)
    stamp = F.col("timestamp")
    far_enough = day_number(stamp - F.make_dt_interval(secs=F.lit(rest))) == day_number(stamp)
    firsts = (
        rows.where(stamp.isNotNull())
        .groupBy("partition_id", day_number(stamp).alias("day_no"))
        .agg(F.min("arrival_seq").alias("_any"), F.min(F.when(far_enough, F.col("arrival_seq"))).alias("_far"))
    )
    newest_first = W.partitionBy("partition_id").orderBy(F.desc("day_no"))
    behind = -whole_days - 1
    closed_by = F.least(
        F.min("_any").over(newest_first.rangeBetween(W.unboundedPreceding, behind - 1)),
        F.min("_far").over(newest_first.rangeBetween(behind, behind)),
    )
    return firsts.select("partition_id", "day_no", closed_by.alias("closed_by")).where("closed_by IS NOT NULL")


def with_lateness(rows: DataFrame, grace_seconds: int = GRACE_SECONDS) -> DataFrame:
    """Add `day_no` and `on_time`: false once the day was closed before the record arrived.

    The closings are written first, so the join broadcasts them while they are small and shuffles
    otherwise; the rows themselves are only filtered in place.
    """
    closings = staged(day_closings(rows, grace_seconds), "day-closings")
    dated = rows.withColumn("day_no", day_number(F.col("timestamp")))
    return (
        dated.join(closings, ["partition_id", "day_no"], "left")
        .withColumn("on_time", F.coalesce(F.col("arrival_seq") < F.col("closed_by"), F.lit(True)))
        .drop("closed_by")
    )
