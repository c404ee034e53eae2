"""Softmax boosting: trees of all classes grown together, level by level, from gradient sums that Spark adds up."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatlake.functions.numbers import clean_features
from threatlake.session import cut_lineage

# fixed values: rounds, depth and learning rate of the family model
FAMILY_BOOSTER = {"rounds": 200, "depth": 8, "rate": 0.1}
#: Split candidates a feature, penalty on leaf weights, least sum of second derivatives of a child, rows of a training task, rounds after
#: which the margins of the training rows are stored again, and the unit in which gradients are added as whole numbers.
BINS, PENALTY, LEAST, TASK_ROWS, STORE_EVERY, UNIT = 128, 1.0, 1.0, 65_536, 10, 2.0**-24


@dataclass
class Trees:
    """Trees of one round, one row a class, nodes in heap order; ``feature`` -1 is a leaf, values <= cut number ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def leaves(cls, classes: int, depth: int) -> Trees:
        shape = (classes, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape))

    def nodes(self, binned: np.ndarray, k: int) -> np.ndarray:
        """The node of each row in the tree of class ``k``."""
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        while True:
            feature = self.feature[k][at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = binned[rows, np.maximum(feature, 0)] > self.cut[k][at]
            at = np.where(inner, 2 * at + 1 + right, at)

    def margins(self, binned: np.ndarray) -> np.ndarray:
        return np.stack([self.value[k][self.nodes(binned, k)] for k in range(len(self.value))], axis=1)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def binned_rows(values: np.ndarray, cuts: list) -> np.ndarray:
    """Number of cuts below each value, per feature."""
    return np.stack([np.searchsorted(c, values[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


@dataclass
class SoftmaxBooster:
    """A fitted model: the cuts of each feature and the trees of each round. Its size is rounds x classes x nodes, whatever it was fitted on."""

    features: list[str]
    labels: list[str]
    cuts: list[np.ndarray]
    rate: float
    rounds: list[Trees] = field(default_factory=list)

    def transform(self, df: DataFrame, probability: str = "probability", prediction: str = "predicted_family") -> DataFrame:
        """Adds an array of probabilities in the order of ``labels``, and the likeliest label (ties: the first)."""
        shared = SparkSession.active().sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def probabilities(values: pd.Series) -> pd.Series:
            model = shared.value
            binned = binned_rows(np.stack(values.to_numpy()).astype(np.float64), model.cuts)
            margins = np.zeros((len(binned), len(model.labels)))
            for trees in model.rounds:
                margins += model.rate * trees.margins(binned)
            return pd.Series(list(softmax(margins)))

        values = F.array(*[F.col(c).cast("double") for c in self.features])
        named = F.array(*[F.lit(x) for x in self.labels])
        p = F.col(probability)
        return df.withColumn(probability, probabilities(values)).withColumn(
            prediction, F.element_at(named, F.array_position(p, F.array_max(p)).cast("int")))

    def save(self, path: str) -> None:
        head = {"features": self.features, "labels": self.labels, "rate": self.rate, "cuts": [c.tolist() for c in self.cuts]}
        rows = [(-1, json.dumps(head))] + [
            (i, json.dumps({n: getattr(t, n).tolist() for n in ("feature", "cut", "value")})) for i, t in enumerate(self.rounds)]
        SparkSession.active().createDataFrame(rows, "round int, content string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> SoftmaxBooster:
        head, *rest = (json.loads(r.content) for r in SparkSession.active().read.parquet(path).orderBy("round").collect())
        trees = [Trees(np.array(t["feature"], np.int16), np.array(t["cut"], np.uint8), np.array(t["value"])) for t in rest]
        return cls(head["features"], head["labels"], [np.array(c) for c in head["cuts"]], head["rate"], trees)


def _level_sums(model: SoftmaxBooster, since: int, trees: Trees, level: int):
    """Sums of both derivatives by (class, node, feature, bin) of a task's rows, in whole units, of the open nodes of one level."""
    first, last = 2**level - 1, 2 ** (level + 1) - 1

    def work(frames):
        held = [(np.stack([np.frombuffer(x, np.uint8) for x in f["x"]]), np.stack(f["margins"].to_numpy()), f["y"].to_numpy(), f["weight"].to_numpy())
                for f in frames if len(f)]
        if not held:
            return
        x, margins, y, weight = (np.concatenate(parts) for parts in zip(*held, strict=True))
        for done in model.rounds[since:]:
            margins = margins + model.rate * done.margins(x)
        p = softmax(margins)
        width, bins = x.shape[1], max(map(len, model.cuts)) + 1
        for k in range(len(model.labels)):
            at = trees.nodes(x, k)
            here = np.flatnonzero((at >= first) & (at < last))
            nodes, place = np.unique(at[here], return_inverse=True)
            if not len(nodes):
                continue
            cell = ((place[:, None] * width + np.arange(width)) * bins + x[here]).ravel()
            pk, w = p[here, k], weight[here]
            sums = []
            for d in (w * (pk - (y[here] == k)), w * pk * (1 - pk)):
                sums.append(np.bincount(cell, np.repeat(np.rint(d / UNIT), width), len(nodes) * width * bins).astype(np.int64))
            some = np.flatnonzero(np.bincount(cell, minlength=len(nodes) * width * bins))
            yield pd.DataFrame({"k": np.full(len(some), k, np.int32), "node": nodes[some // (width * bins)].astype(np.int32),
                                "f": (some // bins % width).astype(np.int32), "bin": (some % bins).astype(np.int32), "g": sums[0][some], "h": sums[1][some]})

    return work


def best_splits(sums: DataFrame, penalty: float = PENALTY, least: float = LEAST) -> DataFrame:
    """(k, node, f, bin, gain, gl, hl, g, h): the best split of each node from sums by (k, node, f, bin); ``gain`` null where none is allowed.

    Rows in bins up to ``bin`` go left. Ties go to the smaller feature, then the smaller bin. Sums are whole numbers,
    so the order in which tasks are added up changes nothing.
    """
    total = sums.repartition("k", "node", "f").groupBy("k", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    one = W.partitionBy("k", "node", "f")
    upto = one.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = total.select("k", "node", "f", "bin", *[(F.sum(c).over(upto) * UNIT).alias(f"{c}l") for c in "gh"], *[(F.sum(c).over(one) * UNIT).alias(c) for c in "gh"])
    part = lambda g, h: g * g / (h + penalty)
    g, h, gl, hl = (F.col(c) for c in ("g", "h", "gl", "hl"))
    gain = part(gl, hl) + part(g - gl, h - hl) - part(g, h)
    allowed = (hl >= least) & (h - hl >= least) & (gain > 1e-9)
    x = x.withColumn("gain", F.when(allowed, F.round(gain, 9)))
    best = F.max_by(F.struct("f", "bin", "gain", "gl", "hl", "g", "h"), F.struct(F.coalesce("gain", F.lit(-1.0)), -F.col("f"), -F.col("bin")))
    return x.groupBy("k", "node").agg(best.alias("s")).select("k", "node", "s.*")


def fit(df: DataFrame, features, label: str, weight: str | None = None, rounds: int = FAMILY_BOOSTER["rounds"], depth: int = FAMILY_BOOSTER["depth"],
        rate: float = FAMILY_BOOSTER["rate"], bins: int = BINS, penalty: float = PENALTY, least: float = LEAST, store_every: int = STORE_EVERY,
        cuts: list | None = None) -> SoftmaxBooster:
    """One tree a class and round under the softmax loss of all classes together.

    Rows are stored once as bins; a level of all trees is one job, in which tasks emit sums by (class, node, feature, bin)
    and SQL finds the best split of every node. The driver holds the trees and the splits of one level, never rows.
    Null and infinite features are 0, null labels are left out, an empty table gives a model without labels. ``cuts`` are
    the split candidates of each feature (at most 255), by default approximate quantiles, which may follow the partitions;
    equal cuts give equal trees for any number of partitions.
    """
    features = list(features)
    rows = clean_features(df.where(F.col(label).isNotNull()), features)
    rows = cut_lineage(rows.select(F.array(*[F.col(c).cast("double") for c in features]).alias("v"), F.col(label).cast("string").alias("label"),
                                   (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight")))
    labels = [r.label for r in rows.select("label").distinct().orderBy("label").collect()]
    if cuts is None:
        wide = rows.select(*[F.col("v")[i].alias(f"f{i}") for i in range(len(features))])
        cuts = wide.approxQuantile(wide.columns, [i / bins for i in range(1, bins)], 0.1 / bins) if labels else [[] for _ in features]
    cuts = [np.unique(c) for c in cuts]
    model = SoftmaxBooster(features, labels, cuts, rate)
    if not labels:
        return model

    def store(frames):
        for f in frames:
            yield pd.DataFrame({"x": [r.tobytes() for r in binned_rows(np.stack(f["v"].to_numpy()), cuts)] if len(f) else [], "y": f["y"], "weight": f["weight"],
                                "margins": [np.zeros(len(labels))] * len(f)})

    schema = "x binary, y int, weight double, margins array<double>"
    code = (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1).cast("int")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    held = cut_lineage(rows.select("v", code.alias("y"), "weight").repartition(parts).mapInPandas(store, schema))
    since = 0
    for number in range(rounds):
        trees = Trees.leaves(len(labels), depth)
        for level in range(depth):
            sums = held.mapInPandas(_level_sums(model, since, trees, level), "k int, node int, f int, bin int, g long, h long")
            opened = False
            for s in best_splits(sums, penalty, least).collect():
                if level == 0:
                    trees.value[s.k, 0] = -s.g / (s.h + penalty)
                if s.gain is None:
                    continue
                opened = True
                trees.feature[s.k, s.node], trees.cut[s.k, s.node] = s.f, s.bin
                trees.value[s.k, 2 * s.node + 1] = -s.gl / (s.hl + penalty)
                trees.value[s.k, 2 * s.node + 2] = -(s.g - s.gl) / (s.h - s.hl + penalty)
            if not opened:
                break
        model.rounds.append(trees)
        if len(model.rounds) - since == store_every and number + 1 < rounds:
            new = model.rounds[since:]

            def update(frames, new=new):
                for f in frames:
                    if len(f):
                        x = np.stack([np.frombuffer(b, np.uint8) for b in f["x"]])
                        f["margins"] = list(np.stack(f["margins"].to_numpy()) + rate * sum(t.margins(x) for t in new))
                    yield f

            held, since = cut_lineage(held.mapInPandas(update, schema)), len(model.rounds)
    return model


def log_loss(scored: DataFrame, label: str, labels: list[str], probability: str = "probability") -> float:
    """Mean of -log of the probability of the true label; rows of other labels are left out."""
    p = F.col(probability) if dict(scored.dtypes)[probability].startswith("array") else vector_to_array(F.col(probability))
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)).cast("int")
    return scored.withColumn("_at", at).where("_at > 0").agg(F.avg(-F.log(F.greatest(F.element_at(p, F.col("_at")), F.lit(1e-15))))).first()[0]
