"""Softmax boosting against a plain loop over whole rows, and against one-against-rest."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from threatlake.functions.numbers import clean_features
from threatlake.ml import boosting, forest


def rows_of(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.8, "DoS", np.where(x[:, 2] * x[:, 1] > 0.4, "Botnet", "Benign"))
    return x, y, spark.createDataFrame([(*map(float, a), str(b)) for a, b in zip(x, y)], "a double, b double, c double, family string")


def plain_round(x, y, labels, margins, cuts, depth, penalty=1.0, least=1.0):
    """Margins that one round adds, by looking at every row for every split."""
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    out = np.zeros_like(margins)
    for k, name in enumerate(labels):
        g, h = p[:, k] - (y == name), p[:, k] * (1 - p[:, k])

        def grow(mine, level, g=g, h=h, k=k):
            total_g, total_h = g[mine].sum(), h[mine].sum()
            out[mine, k] = -total_g / (total_h + penalty)
            best = None
            for f, some in enumerate(cuts) if level < depth else ():
                for cut in some:
                    left = mine & (x[:, f] <= cut)
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = gl**2 / (hl + penalty) + (total_g - gl) ** 2 / (total_h - hl + penalty) - total_g**2 / (total_h + penalty)
                    if hl >= least and total_h - hl >= least and gain > 1e-6 and (best is None or gain > best[0] + 1e-6):
                        best = gain, f, cut
            if best:
                left = mine & (x[:, best[1]] <= best[2])
                grow(left, level + 1)
                grow(mine & ~left, level + 1)

        grow(np.ones(len(x), bool), 0)
    return out


@pytest.mark.parametrize("store_every", [1, 10])
def test_margins_equal_a_plain_loop(spark, store_every):
    x, y, df = rows_of(spark)
    model = boosting.fit(df, ["a", "b", "c"], "family", rounds=3, depth=3, rate=0.3, bins=16, store_every=store_every)
    assert model.labels == ["Benign", "Botnet", "DoS"]
    margins = np.zeros((len(x), 3))
    for trees in model.rounds:
        want = plain_round(x, y, model.labels, margins, model.cuts, 3)
        got = trees.margins(boosting.binned_rows(x, model.cuts))
        assert np.abs(got - want).max() < 1e-5
        margins += 0.3 * got
    scored = model.transform(df).select(*"abc", "probability", "predicted_family").collect()
    at = {tuple(v): boosting.softmax(m[None])[0] for v, m in zip(x, margins)}
    for r in scored:
        assert np.abs(np.array(r.probability) - at[r.a, r.b, r.c]).max() < 1e-9 and r.predicted_family == model.labels[int(np.argmax(r.probability))]


def test_equal_trees_for_any_partitions(spark):
    _, _, df = rows_of(spark, 600, 4)
    one, many = (boosting.fit(df.repartition(n), ["a", "b", "c"], "family", rounds=2, depth=3, cuts=[np.linspace(-2, 2, 9)] * 3) for n in (1, 7))
    for a, b in zip(one.rounds, many.rounds, strict=True):
        assert (a.feature == b.feature).all() and (a.value == b.value).all()


def test_loss_not_above_one_against_rest(spark):
    _, _, df = rows_of(spark, 1500, 5)
    train, held = df.where("pmod(xxhash64(a, b), 3) > 0"), df.where("pmod(xxhash64(a, b), 3) = 0")
    losses = {}
    for kind in (True, "one_against_rest"):
        model = forest.train_family(train, ["a", "b", "c"], "family", booster=kind, trees=15, depth=3)
        if kind is True:
            losses[kind] = boosting.log_loss(model.transform(held), "family", model.labels)
            shorter = boosting.SoftmaxBooster(model.features, model.labels, model.cuts, model.rate, model.rounds[:5])
            assert losses[kind] < boosting.log_loss(shorter.transform(held), "family", model.labels)
        else:
            labels = next(s for s in model.stages if hasattr(s, "labelsArray")).labels
            scored = model.stages[0].transform(clean_features(held, ["a", "b", "c"]))
            scored = forest._one_against_rest(next(s for s in model.stages if hasattr(s, "models")), scored)
            losses[kind] = boosting.log_loss(scored.withColumn("probability", vector_to_array("probability")), "family", labels)
    assert losses[True] <= losses["one_against_rest"]


def test_odd_inputs_and_storage(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), None, 1.0, "x"), (1.0, float("inf"), None, None), (2.0, 1.0, 1.0, "y")] * 20, "a double, b double, c double, family string")
    model = boosting.fit(df, ["a", "b", "c"], "family", rounds=2, depth=2)
    assert model.labels == ["x", "y"]
    model.save(str(tmp_path / "m"))
    again = boosting.SoftmaxBooster.load(str(tmp_path / "m"))
    clean = clean_features(df, ["a", "b", "c"])
    assert again.transform(clean).collect() == model.transform(clean).collect()
    assert boosting.fit(df.where("false"), ["a", "b", "c"], "family").labels == []
    same = boosting.fit(df.where("family = 'x'"), ["a"], "family", rounds=1, depth=2).transform(clean).select(F.col("probability")[0]).distinct().collect()
    assert [r[0] for r in same] == [1.0]
