"""Keeping every task bounded when one key or one source partition holds much of the data.

Rows of a source partition have unique offsets, so `offset div block_rows` cuts a partition into ranges of at most
`block_rows` rows. The blocks of a key are neighbouring ranges with about so many rows of its own. A running value over
a long group is then the running value inside the block, combined with a carry: the same value over all earlier
blocks, which comes from one summary row a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stridelake.session import staged_to_join


@dataclass(frozen=True)
class SkewPolicy:
    """A key with more than `hot_rows` rows is worked on in blocks of about `block_rows` of them."""

    hot_rows: int = 1_000_000
    block_rows: int = 1_000_000


def block_of(policy: SkewPolicy, seq: str = "arrival_seq") -> Column:
    return F.floor(F.col(seq) / F.lit(policy.block_rows)).cast("bigint")


def in_blocks(rows: DataFrame, policy: SkewPolicy, seq: str = "arrival_seq") -> DataFrame:
    """Add `block`: 0, 1, ... along the key's own rows, however thinly they lie in their source partition.

    The rows of each (key, range of offsets) are counted; a block takes ranges until it has `block_rows` rows and so
    has fewer than twice as many.
    """
    ranged = rows.withColumn("_range", block_of(policy, seq))
    before = W.partitionBy("key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy("key", "_range").agg(F.count(F.lit(1)).alias("_n"))
    own = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.lit(policy.block_rows)).cast("bigint")
    blocks = staged_to_join(counts.select("key", "_range", own.alias("block")), "key-blocks")
    return ranged.join(blocks, ["key", "_range"]).drop("_range")


def hot_keys(rows: DataFrame, policy: SkewPolicy) -> DataFrame | None:
    """Keys with more than `hot_rows` rows, counted exactly; None when there is none.

    The count reads the key column alone and sums before it shuffles. There can be no more such keys than all rows
    over the limit. Records without a key are no key.
    """
    counts = rows.where("key IS NOT NULL").groupBy("key").count()
    hot = staged_to_join(counts.where(F.col("count") > policy.hot_rows).select("key"), "hot-keys")
    return None if hot.isEmpty() else hot


def running_max(rows: DataFrame, group: str, value: Column, policy: SkewPolicy) -> DataFrame:
    """Add `running_max`: highest `value` of the group up to and including the row, in arrival order.

    One shuffle of the rows, on (group, block): the carry is joined on the same two columns.
    """
    blocked = rows.withColumn("block", block_of(policy)).withColumn("_value", value)
    earlier = W.partitionBy(group).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        blocked.groupBy(group, "block")
        .agg(F.max("_value").alias("_top"))
        .select(group, "block", F.max("_top").over(earlier).alias("_carry"))
    )
    inside = W.partitionBy(group, "block").orderBy("arrival_seq").rowsBetween(W.unboundedPreceding, 0)
    return (
        blocked.join(carry, [group, "block"])
        .withColumn("running_max", F.greatest("_carry", F.max("_value").over(inside)))
        .drop("block", "_value", "_carry")
    )


def number_in_order(rows: DataFrame, group: str, time: str, tie: str, bucket: str = "minute") -> DataFrame:
    """Add `arrival_seq`: 1, 2, ... in (time, tie) order inside each group.

    `bucket` is a `date_trunc` unit and has to be narrow enough for one task to sort one bucket of a group.
    """
    return ranked(rows, group, [time, tie], F.date_trunc(bucket, F.col(time)), "arrival_seq")


def ranked(rows: DataFrame, group: str, order: list[str], bucket: Column, name: str) -> DataFrame:
    """Add `name`: 1, 2, ... in order inside each group. `bucket` may not be null and must not fall along the order.

    Rows are numbered inside buckets; the offset of a bucket is the count of the buckets before it.
    """
    cut = rows.withColumn("_bucket", bucket)
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy(group, "_bucket").orderBy(*order)
    return (
        cut.join(offsets, [group, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_bucket", "_offset")
    )
