"""A table of the current row of each key, kept up to date by a log of changes with deletes.

Keys are dealt to a fixed number of buckets. A batch of changes is reduced to its last change of each key and merged
with the buckets that it touches; only these are written again, the others stay as they are. Which version of each
bucket holds is written last, in one of two small files that take turns, so a batch that stops halfway leaves the table
as it was, and one that is repeated gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stridelake.operators.latest import latest, present
from stridelake.streaming.sinks import read_if_there

BUCKETS = 64
HELD = "bucket int, version bigint, slot_version bigint"


class KeyedTable:
    """The table in the folder `base`, of rows in `layout` (DDL): `key`, a column that orders the changes, values.

    A change whose values are all null deletes its key. The deleted key stays in the table as such, so that an older
    change that comes late doesn't bring it back; `current` doesn't show it. The order in which changes come makes no
    difference, whatever batches they are cut into.
    """

    def __init__(
        self, spark: SparkSession, base: str, layout: str, key: str = "key", order: str = "change_seq", buckets: int = BUCKETS
    ):
        self.spark, self.base, self.layout, self.key, self.order, self.buckets = spark, base, layout, key, order, buckets

    def merge(self, changes: DataFrame, version: int) -> None:
        """Apply a batch of changes; versions rise, and the last one may be repeated."""
        names = [field.split()[0] for field in self.layout.split(", ")]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        newest = latest(changes.select(*names).where(F.col(self.key).isNotNull()), self.order, self.key)
        newest = newest.withColumn("bucket", bucket).persist()
        try:
            # At most as many numbers as there are buckets.
            touched = sorted(row["bucket"] for row in newest.select("bucket").distinct().collect())
            held = self._held(before=version)
            before = self._read({b: v for b, v in held.items() if b in touched})
            merged = latest(before.unionByName(newest.select(*names)), self.order, self.key).withColumn("bucket", bucket)
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/data/version={version}")
        finally:
            newest.unpersist()
        held.update(dict.fromkeys(touched, version))
        rows = [(b, v, version) for b, v in held.items()]
        self.spark.createDataFrame(rows, HELD).coalesce(1).write.mode("overwrite").parquet(self._slot(version))

    def current(self, before: int | None = None) -> DataFrame:
        """The rows of the keys that are there, as of the newest version, or the newest before the given one."""
        return present(self._read(self._held(before)), self.key, self.order)

    def _slot(self, version: int) -> str:
        return f"{self.base}/held/slot={version % 2}"

    def _held(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket, as of the newest complete batch before the given one."""
        slots = [read_if_there(self.spark, f"{self.base}/held/slot={n}", HELD) for n in (0, 1)]
        found = [slot.collect() for slot in slots if slot is not None]
        found = [rows for rows in found if rows and (before is None or rows[0]["slot_version"] < before)]
        newest = max(found, key=lambda rows: rows[0]["slot_version"], default=[])
        return {row["bucket"]: row["version"] for row in newest}

    def _read(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.base}/data/version={version}/bucket={bucket}" for bucket, version in sorted(held.items())]
        reader = self.spark.read.schema(self.layout)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.layout)


def start_table(changes: DataFrame, table: KeyedTable, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the table up to date with a stream of changes."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(table.merge)
    return (writer.trigger(availableNow=True) if once else writer).start()
