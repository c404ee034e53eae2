"""Steps that must not follow the files of their input: tasks, compiled methods, what a neighbour search stores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlake.checks import evaluation, jobs
from threatlake.checks.registry import Data
from threatlake.functions.numbers import coerce_integers
from threatlake.ml import forest, oversample
from threatlake.session import wide_rows


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """A folder whose tables lie in one row group each, so that a scan has one task."""
    folder = tmp_path_factory.mktemp("one_file")
    n = F.col("id")
    vectors = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.pmod(F.xxhash64(n, i), F.lit(1000)) / 1000).cast("float"))
    spark.range(9000).select(n.alias("vec_id"), vectors.alias("embedding"), (n % 10).cast("int").alias("label")).coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    spark.range(40_000).select(
        n.alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id % 500)").alias("ts"), (n % 100).alias("user_id"),
        F.lit("click").alias("event_type"), (n / 7).alias("value")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_vectors_and_flows_leave_their_file(spark, one_file):
    d = Data(spark, one_file)
    for rows, stored, n in ((evaluation._vectors(d), d.embeddings, 9000), (jobs._flows(d), d.events, 40_000)):
        assert stored.rdd.getNumPartitions() == 1 < rows.rdd.getNumPartitions()
        assert rows.count() == n == rows.distinct().count()


def test_forest_is_fitted_on_spread_rows(spark, one_file, monkeypatch):
    seen = []
    cut = forest.cut_lineage
    monkeypatch.setattr(forest, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    rows = spark.read.parquet(f"{one_file}/embeddings.parquet").select(F.col("embedding")[0].cast("double").alias("x0"), (F.col("label") > 4).cast("int").alias("y"))
    forest.train_binary(rows, ["x0"], "y", numTrees=2, maxDepth=2)
    assert seen[0].rdd.getNumPartitions() > 1 and seen[0].count() == 9000


def test_wide_rows_gives_the_limit_back(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), wide_rows(spark):
        assert spark.conf.get(name) == "8000"
        raise ZeroDivisionError
    assert spark.conf.get(name) == before


def test_integers_of_doubles_as_of_their_text(spark):
    values = [0.5, 1.5, -0.4, 2.4999999, 1e18, 1e300, float("inf"), float("-inf"), float("nan"), None, 123456789.5]
    df = spark.createDataFrame([(v,) for v in values], "d double").withColumn("s", F.col("d").cast("string"))
    assert [r.d for r in coerce_integers(df, ["d"]).collect()] == [r.s for r in coerce_integers(df, ["s"]).collect()]


def test_neighbours_store_each_row_a_bounded_number_of_times(spark, monkeypatch):
    """All rows lie near each other, so no block is ruled out; visits of single rows to blocks would be rows x blocks."""
    seen = []
    cut = oversample.cut_lineage
    monkeypatch.setattr(oversample, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    rng = np.random.default_rng(7)
    points = np.vstack([rng.normal(size=(400, 8)), np.repeat(rng.normal(size=(2, 8)), 50, axis=0)])
    df = spark.createDataFrame([(i // 2 if i < 20 else i, [float(v) for v in p]) for i, p in enumerate(points)] + [(None, [0.0] * 8)], "id bigint, x array<double>")
    near = oversample.nearest_neighbours(df, "id", "x", 3, pivots=4, block=8).collect()
    packs = seen[1].collect()
    assert seen[0].count() == 500 == sum(len(p.ids) // 8 for p in packs) and len(packs) <= 4
    ids = np.array([i // 2 if i < 20 else i for i in range(500)])
    got = {(r.id, r.place): (r.neighbour, r.distance) for r in near}
    for i in set(ids.tolist()):
        pairs = sorted((float(np.sqrt(((points[a] - points[b]) ** 2).sum())), int(ids[b])) for a in np.flatnonzero(ids == i) for b in np.flatnonzero(ids != i))[:3]
        assert [got[i, p + 1][0] for p in range(3)] == [b for _, b in pairs]
        assert np.allclose([got[i, p + 1][1] for p in range(3)], [x for x, _ in pairs], atol=1e-12)
