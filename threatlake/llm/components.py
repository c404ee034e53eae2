"""Connected components by alternating star contraction; every step is an aggregate and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from threatlake.llm.storage import cut_lineage


def _stored(edges: DataFrame, edges_a_task: int | None) -> DataFrame:
    """Cuts lineage; with ``edges_a_task`` the edges are read in as many tasks as their number asks for, not in one per shuffle partition."""
    if not edges_a_task:
        return cut_lineage(edges)
    seen = Observation()
    stored = cut_lineage(edges.observe(seen, F.count("*").alias("n")))
    return stored.coalesce(seen.get["n"] // edges_a_task + 1)


def _tangled(edges: DataFrame) -> bool:
    """True while some node hangs on two nodes, or on a node that itself hangs on another."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60, edges_a_task: int | None = None) -> DataFrame:
    """(node, component) for every node with a link to another; component is the smallest node reachable.

    Links may come in either direction and repeat; links to oneself and links with a null end are ignored. No table
    of neighbours is gathered: a node with very many links contributes map-side minima and splittable join rows.
    The edge set never grows. Raises if ``rounds`` do not suffice (each round at least halves the longest chain).
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = _stored(e, edges_a_task)
    for _ in range(rounds):
        if not _tangled(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select("v", "v").distinct())
        # every larger neighbour of a node hangs on the node's smallest neighbour
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # a node and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = _stored(small.union(low.select("u", "m")).distinct(), edges_a_task)
    raise RuntimeError(f"components not settled after {rounds} rounds")
