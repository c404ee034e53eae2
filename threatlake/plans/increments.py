"""View tables kept up to date by states: what a load adds is counted once and merged with what earlier loads left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threatlake.plans import views as V
from threatlake.sources.loads import all_loads


def load_states(part: DataFrame) -> dict[str, DataFrame]:
    """Mergeable states of some rows of the fact: attacks by day, pair of hosts and label, and by day, minute and label."""
    return {"attack_pairs": V.daily_pairs(part), "attack_minutes": V.daily_minutes(part)}


def write_states(part: DataFrame, root: str, load_id: str) -> None:
    """Replaces the states of one load; reads the rows of that load only."""
    for name, state in load_states(part).items():
        state.write.mode("overwrite").parquet(f"{root}/view_states/{name}/load_id={load_id}")


def views_from_states(spark: SparkSession, root: str, assets: DataFrame, dates: DataFrame, times: DataFrame, attack_types: DataFrame) -> dict[str, DataFrame]:
    """The view tables over all loads, from their states; the fact is not read."""
    pairs, minutes = (all_loads(spark, f"{root}/view_states/{name}") for name in ("attack_pairs", "attack_minutes"))
    return V.views_of(pairs, minutes, assets, dates, times, attack_types)
