"""Writers. Tables that are read while being replaced go through a new version folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def write_snapshot(df: DataFrame, path: str, codec: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_fact(df: DataFrame, path: str, mode: str = "overwrite", partition: str = "date_sk", order: str = "time_sk") -> None:
    """Fact partitioned by day and sorted by time inside each file.

    The rebalance hint lets the adaptive planner cut a day that holds a third of all rows into
    several files of the advisory size and put small days together in one task.
    """
    spread = df.hint("rebalance", partition)
    spread.sortWithinPartitions(partition, order).write.mode(mode).option(
        "partitionOverwriteMode", "static").partitionBy(partition).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str = "date_sk") -> None:
    """Rewrites only the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def write_tables(tables: dict[str, DataFrame], root: str | None = None) -> None:
    """Replaces named tables, in the catalog or as parquet folders below ``root``."""
    for name, df in tables.items():
        if root is None:
            write_table(df, name)
        else:
            write_snapshot(df, f"{root}/{name}")


def next_version(spark: SparkSession, df: DataFrame, root: str, name: str, version: str, replace: bool = False) -> DataFrame:
    """Writes ``root/name/version`` and reads it back; the version read so far stays untouched."""
    path = f"{root}/{name}/{version}"
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)
    return spark.read.parquet(path)


def observed_version(spark: SparkSession, df: DataFrame, root: str, name: str, version: str, metrics: dict[str, Column], replace: bool = False) -> tuple[DataFrame, dict]:
    """``next_version`` and aggregates of the rows, gathered while they are written, without another pass."""
    seen = Observation()
    stored = next_version(spark, df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), root, name, version, replace)
    return stored, seen.get


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, partition: str | None = None) -> None:
    """Replaces a catalog table whose rows lie in ``buckets`` by a hash of ``key``; equally bucketed tables join without moving rows."""
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(partition) if partition else writer).saveAsTable(table)
