"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from threatlake.session import checkpoint_folder, cut_lineage

__all__ = ["cut_lineage", "kept", "shared_path", "write_shared"]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes a table that is read more than once and reads it back; survives the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_shared(spark: SparkSession, name: str, content: bytes) -> str:
    """Writes one small file through Hadoop's file system, so any shared store works; returns its path."""
    path = shared_path(spark, name)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        for i in range(0, len(content), 1 << 20):
            stream.write(bytearray(content[i : i + (1 << 20)]))
    finally:
        stream.close()
    return path
