"""Session settings and the small written tables that cut a plan in two."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# A table of more rows is not broadcast, however small its files are.
BROADCAST_ROWS = 100_000


def build_session(app: str = "stridelake", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Days are UTC days everywhere, so dates must be cut in a UTC session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a private one only for a local master that names none."""
    context = spark.sparkContext
    path = context.getConf().get(CHECKPOINT_DIR) or context.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="stridelake-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    The table read back survives lost executors, is not computed again by each reader, and carries
    its true size: joins against it broadcast below `spark.sql.autoBroadcastJoinThreshold` and
    shuffle above it, so no hint is needed anywhere. `codec` is one of Parquet's, the session's if none.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_to_join(df: DataFrame, name: str) -> DataFrame:
    """`staged`, for a table that rows are joined with and that grows with them.

    Its files can be a fiftieth of what a broadcast holds in memory, where few values repeat in millions of rows, and
    Spark goes by the files. So a table of many rows is merged. The count reads the footers of the files only.
    """
    table = staged(df, name)
    return table if table.count() <= BROADCAST_ROWS else table.hint("merge")
