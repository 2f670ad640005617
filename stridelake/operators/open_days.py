"""The change stream when the grace period leaves more than two days open.

With `epoch` = the key's newest day so far, an activity can count for any of the days epoch to epoch - k, where k is the
grace period in days, rounded up. The total of a day is what earlier epochs have brought for it and what the
current epoch has brought so far: a running sum for each of the k + 1 open days. What the earlier epochs have brought comes
from one row for each (key, epoch, day), of which a label needs the days epoch - 6 to epoch only.

Each open day takes a column of the plan, so this is meant for days to weeks of grace, not for years.

All keys take one way: a row is worked on inside (key, block), and a written table hands each (key, block, epoch)
what lies before it. Regular keys have one block, keys above the skew limit several.

A late day can be older than all seven days kept only from a grace of seven days on. Then the kept days are no longer
the newest ones: the oldest of them leaves before the new one enters. What that leaves is found by walking the
days of each key in arrival order, seven numbers of state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.functions.rules import HISTORY_DAYS, MEDIUM_FROM, WEEK_LOW, WEEK_MEDIUM_OR_HIGH, WEEK_NONE, daily_label
from stridelake.operators.skew import SkewPolicy, in_blocks
from stridelake.operators.timeline import BEFORE, SO_FAR, TIMELINE_FIELDS
from stridelake.session import staged_to_join

OLDEST = HISTORY_DAYS - 1


def timeline_with_open_days(
    activity: DataFrame,
    open_days: int,
    policy: SkewPolicy = SkewPolicy(),
    hot: DataFrame | None = None,
    fresh_label: bool = False,
) -> DataFrame:
    """`timeline.timeline` with `open_days` days open besides the newest one; the same columns and rules."""
    rows = activity.where("key IS NOT NULL AND timestamp IS NOT NULL").selectExpr(
        "key", "arrival_seq", "userId", "timestamp", "day_no", "on_time", "coalesce(steps, 0) AS walked"
    )
    # With fewer open days than are kept, the days kept are the newest ones.
    rows = _with_kept_days(rows) if open_days >= HISTORY_DAYS else rows.selectExpr("*", "true AS unbroken")
    rows = rows.selectExpr("*", "0L AS block", "false AS is_hot")
    if hot is None:
        rows = rows.selectExpr("*", "CAST(NULL AS INT) AS before_epoch")
    else:
        cut = in_blocks(rows.join(hot, "key", "left_semi").drop("block", "is_hot"), policy)
        rows = rows.join(hot, "key", "left_anti").unionByName(cut.selectExpr("*", "true AS is_hot"))
        rows = rows.join(_epochs_before(rows), ["key", "block"])
    in_block = "PARTITION BY key, block ORDER BY arrival_seq"
    rows = rows.selectExpr(
        "*",
        f"greatest(before_epoch, max(CASE WHEN on_time THEN day_no END) OVER ({in_block} {SO_FAR})) AS epoch",
    ).selectExpr("*", "CASE WHEN on_time THEN epoch - day_no END AS back")
    context = staged_to_join(_context(rows, open_days), "open-days")
    if hot is None:
        rows = rows.selectExpr("*", "CAST(NULL AS STRING) AS before_label")
    else:
        rows = rows.join(_labels_before(rows, context), ["key", "block"])
    runs = [
        f"sum(CASE WHEN back = {i} THEN walked END) OVER (PARTITION BY key, block, epoch ORDER BY arrival_seq {SO_FAR})"
        f" AS in_{i}"
        for i in range(open_days + 1)
    ]
    rows = rows.join(context.drop("ends"), ["key", "block", "epoch"], "left").selectExpr("*", *runs)
    rows = rows.selectExpr("*", *[_sum_of(f"in_{i}", f"from_{i}", f"run_{i}") for i in range(open_days + 1)])
    reach = SO_FAR if fresh_label else BEFORE
    out = _labelled(rows, open_days).selectExpr(
        "* EXCEPT (block)",
        "CASE WHEN is_hot THEN block END AS block",
        "date_from_unix_date(day_no) AS day",
        f"CASE {_own_totals(open_days)} END AS steps",
        f"coalesce(last(week_label, true) OVER ({in_block} {reach}), before_label) AS label_seen",
    )
    labelled = out.withColumn("day_label", F.when(F.col("on_time"), daily_label(F.col("steps"))))
    return labelled.select(*TIMELINE_FIELDS)


def _sum_of(one: str, other: str, name: str) -> str:
    """The sum of what is there, null if nothing is."""
    return f"CASE WHEN {one} IS NULL THEN {other} ELSE {one} + coalesce({other}, 0) END AS {name}"


def _epochs_before(rows: DataFrame) -> DataFrame:
    """(key, block, before_epoch): the newest day of the blocks before; a block without a day in time hands it on."""
    tops = rows.groupBy("key", "block").agg(F.max(F.when(F.col("on_time"), F.col("day_no"))).alias("_top"))
    earlier = f"max(_top) OVER (PARTITION BY key ORDER BY block {BEFORE}) AS before_epoch"
    return staged_to_join(tops.selectExpr("key", "block", earlier), "epochs-before")


def _labels_before(rows: DataFrame, context: DataFrame) -> DataFrame:
    """(key, block, before_label): the label at the end of the blocks before; a block without one hands it on."""
    ends = context.groupBy("key", "block").agg(F.max_by("ends", "epoch").alias("_ends"))
    every = rows.select("key", "block").distinct().join(ends, ["key", "block"], "left")
    earlier = f"last(_ends, true) OVER (PARTITION BY key ORDER BY block {BEFORE}) AS before_label"
    return staged_to_join(every.selectExpr("key", "block", earlier), "labels-before")


def _context(rows: DataFrame, open_days: int) -> DataFrame:
    """For each (key, block, epoch): `base`, the totals that earlier epochs have brought for the days epoch - 1,
    epoch - 2, ..., null for a day without records; `from_i`, what earlier blocks of the epoch have brought for day
    epoch - i; `ends`, the label at the end of this block's part of the epoch."""
    reach = max(OLDEST, open_days)
    parts = rows.where("on_time").groupBy("key", "block", "epoch").agg(
        *[F.sum(F.when(F.col("back") == i, F.col("walked"))).alias(f"own_{i}") for i in range(open_days + 1)],
        F.max_by("unbroken", "arrival_seq").alias("unbroken"),
    )
    parts = staged_to_join(parts, "epoch-parts")
    brought = F.array(
        *[F.struct((F.col("epoch") - i).alias("day"), F.sum(f"own_{i}").alias("total")) for i in range(open_days + 1)]
    )
    epochs = parts.groupBy("key", "epoch").agg(brought.alias("brought")).selectExpr(
        "key",
        "epoch",
        "flatten(collect_list(filter(brought, p -> p.total IS NOT NULL)) OVER"
        f" (PARTITION BY key ORDER BY epoch RANGE BETWEEN {reach} PRECEDING AND 1 PRECEDING)) AS brought",
    )
    base = epochs.selectExpr(
        "key",
        "epoch",
        f"""transform(sequence(1, {reach}), j -> aggregate(
              filter(brought, p -> p.day = epoch - j), CAST(NULL AS BIGINT), (s, p) -> coalesce(s, 0L) + p.total)) AS base""",
    )
    by_block = "PARTITION BY key, epoch ORDER BY block"
    ended = parts.join(base, ["key", "epoch"]).selectExpr(
        "*", *[f"sum(own_{i}) OVER ({by_block} {BEFORE}) AS from_{i}" for i in range(open_days + 1)]
    )
    ended = ended.selectExpr("*", "true AS on_time", *[_sum_of(f"own_{i}", f"from_{i}", f"run_{i}") for i in range(open_days + 1)])
    return _labelled(ended, open_days).selectExpr(
        "key", "block", "epoch", "base", *[f"from_{i}" for i in range(open_days + 1)], "week_label AS ends"
    )


def _total(back: int, open_days: int) -> str:
    """The total of day epoch - back after the row, null without a record."""
    if back == 0:
        return "run_0"
    earlier = f"base[{back - 1}]"
    if back > open_days:
        return earlier
    return f"CASE WHEN run_{back} IS NULL THEN {earlier} ELSE run_{back} + coalesce({earlier}, 0) END"


def _own_totals(open_days: int) -> str:
    cases = [f"WHEN back = {i} THEN {_total(i, open_days)}" for i in range(open_days + 1)]
    return "WHEN NOT on_time THEN NULL " + " ".join(cases)


def _labelled(rows: DataFrame, open_days: int) -> DataFrame:
    totals = [f"({_total(back, open_days)})" for back in range(HISTORY_DAYS)]
    some_missing = " OR ".join(f"{total} IS NULL" for total in totals)
    return rows.selectExpr(
        "*",
        f"""CASE WHEN NOT on_time THEN NULL
                 WHEN NOT unbroken OR {some_missing} THEN '{WEEK_NONE}'
                 WHEN least({", ".join(totals)}) < {MEDIUM_FROM} THEN '{WEEK_LOW}'
                 ELSE '{WEEK_MEDIUM_OR_HIGH}' END AS week_label""",
    )


def kept_days(days: list[int], day: int) -> list[int]:
    """The days kept after one more record of `day`, in order; a new one pushes out the oldest, whichever it is."""
    if day in days:
        return days
    return sorted([*(days[1:] if len(days) >= HISTORY_DAYS else days), day])


def _with_kept_days(rows: DataFrame) -> DataFrame:
    """Add `unbroken`: whether the seven days kept after the row follow one another.

    Rows are dealt by key and walked in arrival order, batch by batch; only changes of the day are looked at.
    """
    names = rows.columns
    sent = rows.withColumn("timestamp", F.unix_micros("timestamp"))
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields) + ", unbroken boolean"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, days = None, []
        for batch in batches:
            if batch.empty:
                continue
            keys, numbers, counts = batch["key"].to_numpy(), batch["day_no"].to_numpy(), batch["on_time"].to_numpy(bool)
            changed = np.ones(len(batch), dtype=bool)
            changed[1:] = (keys[1:] != keys[:-1]) | (numbers[1:] != numbers[:-1]) | (counts[1:] != counts[:-1])
            unbroken, state = np.zeros(len(batch), dtype=bool), False
            at = np.flatnonzero(changed)
            for start, end in zip(at.tolist(), [*at[1:].tolist(), len(batch)]):
                if keys[start] != key:
                    key, days = keys[start], []
                if counts[start]:
                    days = kept_days(days, int(numbers[start]))
                state = len(days) == HISTORY_DAYS and days[-1] - days[0] == OLDEST
                unbroken[start:end] = state
            yield batch.assign(unbroken=unbroken)

    dealt = sent.repartition("key").sortWithinPartitions("key", "arrival_seq").mapInPandas(walk, layout)
    return dealt.withColumn("timestamp", F.timestamp_micros("timestamp")).select(*names, "unbroken")
