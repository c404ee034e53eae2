"""Loads of appended facts: a ledger of id ranges, rows numbered over all loads, and folders that a repeated load replaces."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatlake.operators.ordering import broadcast_if_small
from threatlake.sources.sinks import write_fact

LEDGER_SCHEMA = "load_id string, first_id bigint, rows bigint, reserved_at timestamp"
_PART_BITS = 33


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The id ranges handed out so far, empty before the first load."""
    path = f"{root}/meta/meta_loads"
    return spark.read.schema(LEDGER_SCHEMA).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LEDGER_SCHEMA)


def reserve(spark: SparkSession, root: str, load_id: str, rows: int) -> int:
    """First id of a load of ``rows`` rows. A load that is repeated keeps its range; one that has grown gets a new one.

    The high-water mark is the end of the last range, so ids of different loads never meet. One load runs at a time.
    """
    book = ledger(spark, root)
    own = book.filter((F.col("load_id") == load_id) & (F.col("rows") >= rows)).agg(F.max("first_id")).first()[0]
    if own is not None:
        return own
    first = book.agg(F.coalesce(F.max(F.col("first_id") + F.col("rows")), F.lit(0))).first()[0]
    spark.createDataFrame([(load_id, first, rows, datetime.now())], LEDGER_SCHEMA).write.mode("append").parquet(f"{root}/meta/meta_loads")
    return first


def stored_with_ids(spark: SparkSession, rows: DataFrame, root: str, load_id: str, key: str = "event_id", **metrics) -> tuple[DataFrame, dict]:
    """(rows as stored, with consecutive ids; metrics gathered while they were written, ``rows`` among them).

    A row is stored with its place in its task; the tasks' row counts, one row a task, turn places into ids. Nothing is sorted or shuffled.
    """
    seen, path = Observation(), f"{root}/extracted/{load_id}"
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    placed.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in metrics.items()]).write.mode("overwrite").parquet(path)
    found, stored = seen.get, spark.read.parquet(path)
    first = reserve(spark, root, load_id, found["rows"])
    part = F.shiftright("_at", _PART_BITS)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = broadcast_if_small(counts.select("_part", before.alias("_before")), ["_part"])
    numbered = stored.withColumn("_part", part).join(starts, "_part").withColumn(
        key, F.lit(first) + F.col("_before") + F.col("_at").bitwiseAND((1 << _PART_BITS) - 1))
    return numbered.drop("_part", "_before", "_at"), found


def write_load(df: DataFrame, path: str, load_id: str) -> None:
    """Writes one load of a fact, by day, into a folder of its own; a repeated load replaces itself and nothing else."""
    write_fact(df, f"{path}/load_id={load_id}")


def all_loads(spark: SparkSession, path: str) -> DataFrame:
    """The fact over all its loads; ``load_id`` is a column by which scans are pruned."""
    return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path)


def one_load(spark: SparkSession, path: str, load_id: str) -> DataFrame:
    """The rows of one load; no other folder is listed or read."""
    return spark.read.option("basePath", path).parquet(f"{path}/load_id={load_id}")
