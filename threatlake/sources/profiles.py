"""Looking at stored data: JSON keys, time spans, column types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct top-level keys of a JSON text column; rows that are no object are skipped."""
    keys = F.explode(F.map_keys(F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>")))
    return df.select(keys.alias("key")).distinct()


def time_span(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(
        F.min(ts).alias("earliest"), F.max(ts).alias("latest"), F.countDistinct(F.col(ts).cast("date")).alias("days"))


def type_profile(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns per table and type, from the schemas alone."""
    rows = [(name, kind) for name, df in tables.items() for _, kind in df.dtypes]
    columns = spark.createDataFrame(rows, "table_name string, column_type string")
    return columns.groupBy("table_name", "column_type").agg(F.count("*").alias("columns"))
