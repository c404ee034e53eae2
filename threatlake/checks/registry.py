"""Named queries with their SQL twins, and the shaped inputs both sides share."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from threatlake.checks.inputs import INPUTS

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Data:
    """Tables of one folder, and the shaped inputs, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if f"fx_{name}" in INPUTS:
            text = INPUTS[f"fx_{name}"]
            used = {k: getattr(self, k.removeprefix("fx_")) for k in _names(text)}
            return self.spark.sql(text, **used)
        raise AttributeError(name)


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def _with_inputs(sql: str) -> str:
    """Prefixes the shaped inputs a SQL text mentions, in the order they depend on each other."""
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        if name in parts:
            return
        text = INPUTS[name]
        for used in _names(text):
            if used in INPUTS:
                need(used)
        parts[name] = f"{name} AS ({text.format(**{n: n for n in _names(text)})})"

    for name in dict.fromkeys(re.findall(r"\bfx_\w+", sql)):
        need(name)
    body = sql.strip()
    if not parts:
        return body
    heads = ", ".join(parts.values()).replace("TIMESTAMP_NTZ", "TIMESTAMP")
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Data], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of ``Data``; ``sql`` is the equivalent text for another engine."""

    def register(build):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = Query(key, build, _with_inputs(sql) if sql else None)
        return build

    return register
