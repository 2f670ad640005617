"""Join with a table that is given as a log of changes: each record sees the table as it stands at its own moment.

Both logs are put into one, in order of time, and each record takes the last change of its key before it: one shuffle
and one sort, no pairs. A key above the skew limit is worked on in blocks of its own rows; the last change of the
blocks before comes from one summary row for each block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.operators.skew import SkewPolicy, hot_keys, in_blocks, ranked
from stridelake.session import staged_to_join

SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
#: Order at one instant: a change comes before the record that is to see it.
CHANGE, RECORD, LATER_CHANGE = 0, 1, 2


def as_of(
    records: DataFrame,
    changes: DataFrame,
    time: str = "timestamp",
    inclusive: bool = True,
    policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """All `records` with the columns that `changes` has besides key, time and change_seq, as of the record's time.

    Both have `key` and the column named by `time`; changes at one instant are ordered by `change_seq`, records by
    `arrival_seq`. A change whose values are all null takes the key out of the table: records see nulls, as they do
    before the first change. A change at the very instant of a record is seen if `inclusive`. Records without a key or
    a time see nothing, changes without either do nothing. For the state of the table at the moment a
    record is processed, late or not, let `time` be the clock of its source partition (`event_time`).
    """
    values = [name for name in changes.columns if name not in ("key", time, "change_seq")]
    clash = sorted(set(values) & set(records.columns))
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    placed = F.col("key").isNotNull() & F.col(time).isNotNull()
    kinds = {f.name: f.dataType for f in changes.schema.fields}
    out = [F.lit(None).cast(kinds[name]).alias(name) for name in values]
    unplaced = records.where(~placed).select("*", *out)
    record, change = F.struct(*records.columns), F.struct(*values)
    tag = CHANGE if inclusive else LATER_CHANGE
    log = (
        changes.where(placed)
        .select("key", F.col(time).alias("_time"), F.lit(tag).alias("_tag"), F.col("change_seq").alias("_seq"), change.alias("_change"))
        .unionByName(
            records.where(placed).select(
                "key", F.col(time).alias("_time"), F.lit(RECORD).alias("_tag"), F.col("arrival_seq").alias("_seq"), record.alias("_record")
            ),
            allowMissingColumns=True,
        )
    )
    hot = hot_keys(log.select("key"), policy)
    if hot is None:
        seen = _seen(log, "key")
    else:
        seen = _seen(log.join(hot, "key", "left_anti"), "key").unionByName(
            _seen_in_blocks(log.join(hot, "key", "left_semi"), policy)
        )
    found = seen.where("_record IS NOT NULL").select("_record.*", *[F.col(f"_change.{name}").alias(name) for name in values])
    return found.unionByName(unplaced)


def _seen(log: DataFrame, group: str) -> DataFrame:
    last = f"last(_change, true) OVER (PARTITION BY {group} ORDER BY _time, _tag, _seq {SO_FAR})"
    return log.selectExpr("_record", f"{last} AS _change")


def _seen_in_blocks(log: DataFrame, policy: SkewPolicy) -> DataFrame:
    # Rows in order of time have no offsets yet: they are numbered by hours first.
    order = ["_time", "_tag", "_seq"]
    rows = in_blocks(ranked(log, "key", order, F.date_trunc("hour", F.col("_time")), "_rank"), policy, "_rank")
    ends = rows.where("_change IS NOT NULL").groupBy("key", "block").agg(F.max_by("_change", "_rank").alias("_ends"))
    every = rows.select("key", "block").distinct().join(ends, ["key", "block"], "left")
    carry = staged_to_join(
        every.selectExpr(
            "key",
            "block",
            "last(_ends, true) OVER (PARTITION BY key ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
            " AS _before",
        ),
        "as-of-carries",
    )
    last = f"last(_change, true) OVER (PARTITION BY key, block ORDER BY _rank {SO_FAR})"
    return rows.join(carry, ["key", "block"]).selectExpr("_record", f"coalesce({last}, _before) AS _change")
