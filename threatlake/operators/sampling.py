"""Repeatable stratified samples, splits and row-limited runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.operators.ordering import rank_by_hash, seeded_order


def stratified_sample(df: DataFrame, stratum: list[str], ids: list[str], per_stratum: int, seed: int = 42) -> DataFrame:
    """``per_stratum`` pseudo-random rows of every stratum, all of a smaller one."""
    order = seeded_order(*[F.col(c) for c in ids], seed=seed)
    return rank_by_hash(df, stratum, order, first=per_stratum).drop("rn", "_size")


def extract_sample(df: DataFrame, stratum: str, ids: list[str], size: int, seed: int = 42) -> DataFrame:
    """Development sample: a tenth of the wanted size from every stratum, at least one row."""
    return stratified_sample(df, [stratum], ids, max(1, size // 10), seed)


def stratified_split(
    df: DataFrame, stratum: list[str], ids: list[str], test: float = 0.2, val: float = 0.1, seed: int = 42,
) -> DataFrame:
    """Adds ``split``: test, val or train in exact proportions inside every stratum."""
    order = seeded_order(*[F.col(c) for c in ids], seed=seed)
    ranked = rank_by_hash(df, stratum, order)
    n_test = F.round(F.col("_size") * test)
    n_val = F.round(F.col("_size") * val)
    split = F.when(F.col("rn") <= n_test, "test").when(F.col("rn") <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("rn", "_size")


def first_rows(df: DataFrame, by: str | Column, limit: int | None) -> DataFrame:
    """Row-limited run; without a limit the frame is returned as it is."""
    return df if limit is None else df.orderBy(by).limit(limit)
