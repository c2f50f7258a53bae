"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """Session with the settings the plans rely on; a cluster passes its own on top.

    AQE coalesces small shuffle partitions and splits skewed join partitions; the advisory size
    rather than a partition count is what is tuned, so the same settings serve any volume.
    """
    builder = SparkSession.builder.appName("tidewatch")
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        # Joins whose smaller side fits per task are hashed, not sorted.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
    }
    options.update({key.replace("__", "."): value for key, value in settings.items()})
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the session's checkpoint folder.

    A new local one serves where none is set and all executors are this machine; elsewhere that is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewatch-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once, so that several passes may read it.

    The copy is on shared storage: losing executors loses nothing.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: computed once, and columns are read as needed.

    As with ``cut``, losing executors loses nothing. The table stays until the shared folder is emptied.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
