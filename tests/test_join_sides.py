"""Staged tables of many rows are merged with, however well their files compress."""

from pyspark.sql import functions as F

from stridelake.operators.debounce import debounce
from stridelake.operators.skew import SkewPolicy, in_blocks

ROWS = 120_000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_many_ranges_are_not_broadcast(spark):
    rows = spark.range(ROWS).selectExpr("cast(id % 3 AS string) AS key", "id AS arrival_seq")
    cut = in_blocks(rows, SkewPolicy(hot_rows=0, block_rows=1))
    assert "SortMergeJoin" in plan_of(cut) and "Broadcast" not in plan_of(cut)
    got = cut.agg(F.count(F.lit(1)), F.countDistinct("key", "block"), F.max("block")).first()
    assert tuple(got) == (ROWS, ROWS, ROWS // 3 - 1)
    few = in_blocks(rows, SkewPolicy(hot_rows=0, block_rows=1000))
    assert "BroadcastHashJoin" in plan_of(few)


def test_states_of_many_blocks_are_not_broadcast(spark):
    rows = spark.range(ROWS).selectExpr(
        "cast(id % 4000 AS string) AS key", "id AS arrival_seq", "timestamp_seconds(id) AS timestamp", "id div 4000 AS block"
    )
    kept = debounce(rows, 6000, blocked=True)
    assert "SortMergeJoin" in plan_of(kept) and "Broadcast" not in plan_of(kept)
    # Candidates of a key are 4000 s apart, so every second one is kept.
    got = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("block") % 2).cast("int")).alias("odd"))
    assert got.select("n", "odd").distinct().collect() == [(15, 0)]
