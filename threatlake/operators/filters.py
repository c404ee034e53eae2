"""Row filters and set tests on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.functions.numbers import to_double


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in every named column."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns]))


def incomplete_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in all and rows ``drop_incomplete`` takes away; reads the named columns only."""
    complete = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])
    return df.agg(F.count("*").alias("rows_in"), F.count_if(~complete).alias("dropped"))


def labeled(df: DataFrame, column: str = "is_attack") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def all_of(*conditions: Column | None) -> Column:
    """AND of the given conditions; absent ones are skipped."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def is_in(column: Column, wanted: list | None) -> Column | None:
    return column.isin(list(wanted)) if wanted else None


def at_least(column: Column, limit: float) -> Column | None:
    return column >= limit if limit > 0 else None


def after_baseline(days: DataFrame, baselines: DataFrame, key: str = "user_sk", day: str = "feature_date") -> DataFrame:
    """Days from the end of a user's own baseline on; users without one are dropped."""
    ends = baselines.select(key, "baseline_to")
    return days.join(ends, key).filter(F.col(day) >= F.col("baseline_to")).drop("baseline_to")


def of_latest(df: DataFrame, column: str) -> DataFrame:
    """Rows of the latest value, found by a scalar subquery."""
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def non_numeric_values(df: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """Most frequent values that are missing, infinite, NaN or no number."""
    text = F.col(column)
    return (
        df.filter(to_double(text).isNull()).groupBy(text.alias("value")).agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc_nulls_first("value")).limit(limit)
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_union(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    return union_all([f.select(*columns).distinct() for f in frames]).distinct()


def keys_missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def keys_shared(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_semi")
