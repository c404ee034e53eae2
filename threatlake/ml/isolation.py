"""Isolation forest (Liu, Ting and Zhou, 2008): trees from small samples, distributed scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.functions.numbers import clean_features, flag

NODE_SCHEMA = "tree int, node int, feature int, split double, below int, above int, path double"
EULER = 0.5772156649015329


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def tree_samples(df: DataFrame, ids: list[str], trees: int, sample: int, seed: int, rows: int) -> DataFrame:
    """(tree, row) pairs: each tree draws its own rows of the whole table by a seeded hash per (row, tree).

    A tree draws about 1.6 times ``sample`` rows and keeps the first of them; trees are independent of each other.
    """
    unit = 2.0**63
    per_tree = min(1.0, 1.6 * sample / max(rows, 1))

    def draw(*parts):
        return F.shiftrightunsigned(F.xxhash64(*parts), 1) / F.lit(unit)

    mine = F.filter(F.sequence(F.lit(1), F.lit(trees)), lambda t: draw(F.lit(seed + 1), t, *[F.col(c) for c in ids]) < per_tree)
    return df.withColumn("tree", F.explode(mine)).withColumn(
        "_draw", draw(F.lit(seed + 1), F.col("tree"), *[F.col(c) for c in ids]))


@dataclass
class IsolationForest:
    """Flat node table of all trees; its size is bounded by trees * (2 * sample - 1)."""

    features: tuple[str, ...]
    sample: int
    nodes: pd.DataFrame

    def score(self, df: DataFrame, out: str = "anomaly_raw") -> DataFrame:
        """Adds 2 ** (-mean path / c): near 1 for outliers, below .5 for the crowd.

        The node table travels to the executors once as a broadcast variable.
        """
        trees = [g.sort_values("node") for _, g in self.nodes.groupby("tree")]
        packed = [tuple(g[c].to_numpy() for c in ("feature", "split", "below", "above", "path")) for g in trees]
        shared = df.sparkSession.sparkContext.broadcast(packed)
        usual = mean_path(self.sample)

        @F.pandas_udf("double")
        def anomaly(columns: pd.DataFrame) -> pd.Series:
            x = columns.to_numpy(dtype=float)
            total = np.zeros(len(x))
            every = np.arange(len(x))
            for feature, split, below, above, path in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                open_rows = every[feature[at] >= 0]
                while open_rows.size:
                    here = at[open_rows]
                    left = x[open_rows, feature[here]] < split[here]
                    at[open_rows] = np.where(left, below[here], above[here])
                    open_rows = open_rows[feature[at[open_rows]] >= 0]
                total += path[at]
            return pd.Series(np.power(2.0, -(total / len(shared.value)) / usual))

        return clean_features(df, self.features).withColumn(out, anomaly(F.struct(*self.features)))


def _grow(tree: int, x: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, None, None)]
    while stack:
        rows, depth, parent, side = stack.pop()
        number = len(nodes)
        if parent is not None:
            nodes[parent][side] = number
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or not usable.size:
            nodes.append([tree, number, -1, 0.0, -1, -1, depth + mean_path(len(rows))])
            continue
        feature = int(rng.choice(usable))
        split = float(rng.uniform(low[feature], high[feature]))
        left = x[rows, feature] < split
        if not left.any():
            left = x[rows, feature] <= low[feature]
            split = float(np.nextafter(low[feature], np.inf))
        nodes.append([tree, number, feature, split, -1, -1, 0.0])
        stack.append((rows[~left], depth + 1, number, 5))
        stack.append((rows[left], depth + 1, number, 4))
    return [tuple(n) for n in nodes]


def train(df: DataFrame, features, ids: list[str], trees: int = 200, sample: int = 256, seed: int = 42) -> IsolationForest:
    """Each tree is grown in its own task from its own sample of at most ``sample`` rows."""
    features = tuple(features)
    clean = clean_features(df.select(*dict.fromkeys([*ids, *features])), features)
    rows = clean.count()
    size = min(sample, rows)
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_draw", *ids]).head(size)
        tree = int(pdf["tree"].iloc[0])
        found = _grow(tree, pdf[list(features)].to_numpy(dtype=float), np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame(found, columns=["tree", "node", "feature", "split", "below", "above", "path"])

    drawn = tree_samples(clean, ids, trees, size, seed, rows)
    nodes = drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    return IsolationForest(features, size, nodes)


def train_on_benign(df: DataFrame, features, ids: list[str], family: str, benign: str = "Benign", **kw) -> IsolationForest:
    return train(df.filter(F.col(family) == benign), features, ids, **kw)


def min_max(df: DataFrame, raw: str, out: str = "anomaly_score") -> DataFrame:
    """Raw scores to [0, 1] by the extremes of the whole table, not of a chunk."""
    span = df.agg(F.struct(F.min(raw).alias("low"), F.max(raw).alias("high"))).scalar()
    low, high = F.col("_span.low"), F.col("_span.high")
    return df.withColumn("_span", span).withColumn(out, (F.col(raw) - low) / (high - low + 1e-10)).drop("_span")


def anomaly_flag(score: Column, threshold: float = 0.5) -> Column:
    return flag(score >= threshold)
