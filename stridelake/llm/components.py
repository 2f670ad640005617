"""Connected components of a link table by rounds of joins; nothing of the graph comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.session import staged


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for each id in the links (a, b).

    Large-star and small-star steps take turns until a round changes nothing: each node's neighbours are linked to
    the smallest one among them, first the larger neighbours, then the smaller. Rounds grow with the logarithm of
    the longest path. The links of a node are never gathered: each is joined with its node's minimum.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = staged(small.where("u <> v").unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "links")
        state = edges.agg(
            F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        # One link for each node, and none changed: every node hangs on the root of its star.
        if state[0] == state[1] and state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
