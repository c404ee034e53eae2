"""Loads every query module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threatlake.checks import evaluation, flows, insiders, jobs, stars  # noqa: F401 - registration
from threatlake.checks.registry import QUERIES, Data


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name].build(Data(spark, folder))


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(name):
        return lambda spark, folder: run(name, spark, folder)

    return {name: bind(name) for name in QUERIES}


def sql_texts() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
