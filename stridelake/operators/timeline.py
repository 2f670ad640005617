"""The change stream: for each activity the running day total, the weekly label it causes, the label it sees.

The seven days kept for a key are its latest active days, and any label but '' needs them to be adjacent.
So with `epoch` = the key's newest day so far, a label other than '' means that all days from epoch - 6 to
epoch are active. The grace period (below one day) leaves only two days open, epoch and epoch - 1:

* days epoch - 6 to epoch - 2 are closed, their final totals can be used;
* epoch - 1 stands at its total from its own epoch, plus late records since;
* epoch stands at its running total.

All of it is window functions over (key, arrival order). Keys above the skew limit take the same rules in
blocks, with carries computed from one summary row for each (key, block, epoch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stridelake.functions.rules import (
    HISTORY_DAYS,
    MEDIUM_FROM,
    WEEK_LOW,
    WEEK_MEDIUM_OR_HIGH,
    WEEK_NONE,
    daily_label,
)
from stridelake.operators.skew import SkewPolicy, in_blocks
from stridelake.session import staged_to_join

TIMELINE_FIELDS = [
    "key",
    "block",
    "arrival_seq",
    "userId",
    "timestamp",
    "day",
    "on_time",
    "steps",
    "day_label",
    "week_label",
    "label_seen",
]

OPEN_DAYS = 2
OLDEST = HISTORY_DAYS - 1

# Windows of the key: all rows of the epoch, of earlier epochs, and up to the row in arrival order.
IN_EPOCH = "(PARTITION BY key, epoch)"
EARLIER = "(PARTITION BY key ORDER BY epoch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
RUNNING = ("run_own", "run_late", "run_late_rows")


def timeline(
    activity: DataFrame,
    policy: SkewPolicy = SkewPolicy(),
    hot: DataFrame | None = None,
    fresh_label: bool = False,
) -> DataFrame:
    """One row for each activity, with TIMELINE_FIELDS.

    Records without a key or a time are left out, and a missing step count is zero. `activity` carries `day_no` and `on_time` (see `event_time.with_lateness`). Records that are not on time
    change nothing and have null `steps` (the running total), `day_label` and `week_label`.
    `label_seen` is the label as of the key's previous activity, or the current one with `fresh_label`;
    null when the key has no label yet. `block` is null except for the keys in `hot`.
    """
    rows = activity.where("key IS NOT NULL AND timestamp IS NOT NULL").selectExpr(
        "key", "arrival_seq", "userId", "timestamp", "day_no", "on_time", "coalesce(steps, 0) AS walked"
    )
    if hot is None:
        labelled = _regular(rows, fresh_label)
    else:
        regular = _regular(rows.join(hot, "key", "left_anti"), fresh_label)
        labelled = regular.unionByName(_in_blocks(rows.join(hot, "key", "left_semi"), policy, fresh_label))
    return labelled.withColumn("day_label", F.when(F.col("on_time"), daily_label(F.col("steps")))).select(
        *TIMELINE_FIELDS
    )


def _regular(rows: DataFrame, fresh_label: bool) -> DataFrame:
    rows = rows.selectExpr(
        "*",
        f"max(CASE WHEN on_time THEN day_no END) OVER (PARTITION BY key ORDER BY arrival_seq {SO_FAR}) AS epoch",
    )
    rows = _split_by_day(rows).selectExpr(
        "*",
        *_sums("(PARTITION BY key, epoch ORDER BY arrival_seq " + SO_FAR + ")", *RUNNING),
        *_sums(IN_EPOCH, "epoch_own", "epoch_late", "epoch_late_rows"),
    )
    rows = _labelled(_closed_days(rows))
    # Epochs never step back, so (epoch, arrival_seq) is arrival order and the sort above is kept.
    reach = SO_FAR if fresh_label else BEFORE
    return rows.selectExpr(
        *_output("CAST(NULL AS BIGINT)"),
        f"last(week_label, true) OVER (PARTITION BY key ORDER BY epoch, arrival_seq {reach}) AS label_seen",
    )


def _in_blocks(rows: DataFrame, policy: SkewPolicy, fresh_label: bool) -> DataFrame:
    rows = in_blocks(rows, policy)

    # The next day's first record is what turns later records of a day into late ones.
    by_day = W.partitionBy("key").orderBy("day_no")
    openings = staged_to_join(
        rows.where("on_time")
        .groupBy("key", "day_no")
        .agg(F.min("arrival_seq").alias("_first"))
        .select("key", "day_no", F.min("_first").over(by_day.rangeBetween(1, 1)).alias("_next_day_from")),
        "day-openings",
    )
    is_late = "CAST(coalesce(arrival_seq > _next_day_from, false) AS INT)"
    rows = _split_by_day(
        rows.join(openings, ["key", "day_no"], "left").selectExpr(
            "*", f"CASE WHEN on_time THEN day_no + {is_late} END AS epoch"
        )
    )
    carries = staged_to_join(_carries(rows), "epoch-carries").withColumnsRenamed(
        {"key": "_key", "block": "_block", "epoch": "_epoch"}
    )
    same = (
        (F.col("key") == F.col("_key"))
        & (F.col("block") == F.col("_block"))
        & F.col("epoch").eqNullSafe(F.col("_epoch"))
    )
    rows = rows.join(carries, same, "left")
    in_block = f"(PARTITION BY key, block, epoch ORDER BY arrival_seq {SO_FAR})"
    rows = rows.selectExpr("*", *_sums(in_block, *[f"in_{name}" for name in RUNNING])).selectExpr(
        "*", *[f"coalesce(in_{name}, 0) + coalesce(from_{name}, 0) AS {name}" for name in RUNNING]
    )
    reach = SO_FAR if fresh_label else BEFORE
    return _labelled(rows).selectExpr(
        *_output("block"),
        f"coalesce(last(week_label, true) OVER (PARTITION BY key, block ORDER BY arrival_seq {reach}), from_label)"
        " AS label_seen",
    )


def _carries(rows: DataFrame) -> DataFrame:
    """For each (key, block, epoch): what the blocks before it hand over, and the key's closed days."""
    parts = rows.groupBy("key", "block", "epoch").agg(
        F.sum("own").alias("own"), F.sum("late").alias("late"), F.count("late").alias("late_rows")
    )
    sums = ["own", "late", "late_rows"]
    by_block = "PARTITION BY key, epoch ORDER BY block"
    parts = parts.selectExpr(
        "key",
        "block",
        "epoch",
        *[f"sum({part}) OVER ({by_block} {BEFORE}) AS from_run_{part}" for part in sums],
        *[f"coalesce(sum({part}) OVER ({by_block} {SO_FAR}), 0) AS run_{part}" for part in sums],
        *[f"sum({part}) OVER {IN_EPOCH} AS epoch_{part}" for part in sums],
        "epoch IS NOT NULL AS on_time",
    )
    # A block ends with the label of its newest epoch; a block of records out of time has none.
    whole_block = "(PARTITION BY key, block ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    earlier_blocks = "(PARTITION BY key ORDER BY block RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        _labelled(_closed_days(parts))
        .selectExpr("*", f"last(week_label, true) OVER {whole_block} AS _ends")
        .selectExpr(
            "key",
            "block",
            "epoch",
            *[f"from_{name}" for name in RUNNING],
            "previous_epoch",
            "previous_own",
            "active_since",
            "last_low",
            f"last(_ends, true) OVER {earlier_blocks} AS from_label",
        )
    )


def _split_by_day(rows: DataFrame) -> DataFrame:
    """Steps for the epoch's own day and steps that came late for the day before."""
    return rows.selectExpr(
        "*",
        "CASE WHEN on_time AND day_no = epoch THEN walked END AS own",
        "CASE WHEN on_time AND day_no <> epoch THEN walked END AS late",
    )


def _sums(window: str, own: str, late: str, late_rows: str) -> list[str]:
    return [
        f"sum(own) OVER {window} AS {own}",
        f"sum(late) OVER {window} AS {late}",
        f"count(late) OVER {window} AS {late_rows}",
    ]


def _closed_days(rows: DataFrame) -> DataFrame:
    """Add what the row's epoch finds behind it, from the totals of the key's earlier epochs.

    * `previous_epoch` and `previous_own`: the epoch before and its own day's total at its end;
    * `active_since`: first day of the unbroken run of active days that ends with the previous epoch;
    * `last_low`: newest low day among the closed ones (before epoch - 1).

    A day can be active through late records alone: they are found in the epoch that follows it. All values
    are the same on all rows of an epoch and only maxima are taken, so rows need not be told apart.
    """
    next_to = "(previous_epoch <=> epoch - 1)"
    late_only = f"(NOT {next_to} AND epoch_late_rows > 0)"
    previous_final = f"(previous_own + CASE WHEN {next_to} THEN coalesce(epoch_late, 0) ELSE 0 END)"
    return (
        rows.selectExpr(
            "*",
            f"last(epoch) OVER {EARLIER} AS previous_epoch",
            f"last(epoch_own) OVER {EARLIER} AS previous_own",
        )
        .selectExpr(
            "*",
            f"""CASE WHEN {next_to} OR ({late_only} AND previous_epoch = epoch - 2) THEN NULL
                     WHEN {late_only} THEN epoch - 1 ELSE epoch END AS _start""",
            f"CASE WHEN {previous_final} < {MEDIUM_FROM} THEN previous_epoch END AS _low",
            f"CASE WHEN {late_only} AND epoch_late < {MEDIUM_FROM} THEN epoch - 1 END AS _late_low",
        )
        .selectExpr(
            "*",
            f"max(_start) OVER {EARLIER} AS active_since",
            f"""greatest(max(greatest(_low, _late_low)) OVER {EARLIER},
                         CASE WHEN NOT {next_to} THEN _low END) AS last_low""",
        )
    )


def _labelled(rows: DataFrame) -> DataFrame:
    """Weekly label after the row; null when the row is not on time."""
    next_to = "previous_epoch = epoch - 1"
    previous = f"CASE WHEN {next_to} THEN previous_own ELSE 0 END + coalesce(run_late, 0)"
    adjacent = f"""coalesce(active_since <= epoch - {OLDEST}
                   AND ({next_to} OR (previous_epoch = epoch - {OPEN_DAYS} AND run_late_rows > 0)), false)"""
    return rows.selectExpr("*", f"{previous} AS _previous_total").selectExpr(
        "*",
        f"""CASE WHEN NOT on_time THEN NULL
                 WHEN NOT {adjacent} THEN '{WEEK_NONE}'
                 WHEN coalesce(last_low >= epoch - {OLDEST}, false) OR _previous_total < {MEDIUM_FROM}
                      OR coalesce(run_own, 0) < {MEDIUM_FROM} THEN '{WEEK_LOW}'
                 ELSE '{WEEK_MEDIUM_OR_HIGH}' END AS week_label""",
    )


def _output(block: str) -> list[str]:
    return [
        "key",
        f"{block} AS block",
        "arrival_seq",
        "userId",
        "timestamp",
        "date_from_unix_date(day_no) AS day",
        "on_time",
        "CASE WHEN on_time THEN CASE WHEN day_no = epoch THEN run_own ELSE _previous_total END END AS steps",
        "week_label",
    ]
