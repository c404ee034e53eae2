"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # resolved keys and dates: fact partitions are rewritten one by one, never the whole table
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # checkpoint files go when the frames that use them are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "threatlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings above; a cluster's own master and sizes are left alone."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def wide_rows(spark: SparkSession) -> Iterator[None]:
    """Inside, rows of many columns run in methods that the JVM compiles: HotSpot interprets methods of more than 8000 bytes for good.

    The session's own limit is back afterwards.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where the setting is absent, a folder in the warehouse, which is shared too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows up to which a task keeps rows that one file or row group may hold together, and tasks a core beyond which they grow instead.
TASK_ROWS, TASKS_A_CORE = 4096, 16


def spread(df: DataFrame, rows_each: int = TASK_ROWS, waves: int = TASKS_A_CORE) -> DataFrame:
    """The rows dealt out evenly over tasks; a scan alone follows files and row groups, so a large table may sit in one task.

    Up to ``rows_each`` rows stay as they are; ``waves`` bounds the tasks per core. ``df`` is counted, so give a stored or a narrow frame.
    """
    parts = min(-(-df.count() // rows_each), waves * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts) if parts > 1 else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
