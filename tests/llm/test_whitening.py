"""Whitening against one dense decomposition of all vectors, rank-one updates against the same."""

import numpy as np
import pytest

from threatlake.llm import queries, whitening
from threatlake.llm.spectrum import Spectrum

RNG = np.random.default_rng(3)
TABLES = {
    "uneven": np.floor(64 * RNG.normal(size=(300, 12)) * RNG.uniform(0.01, 3, 12)),
    "flat": np.floor(50 * RNG.normal(size=(200, 3)) @ RNG.normal(size=(3, 9))),
    "constant": np.ones((20, 5)),
    "repeated": np.repeat(RNG.integers(0, 9, (6, 7)).astype(float), 30, axis=0),
    "binary": RNG.integers(0, 2, (100, 8)).astype(float),
    "one column": RNG.integers(0, 50, (40, 1)).astype(float),
}


def scatter(x):
    return (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))


@pytest.mark.parametrize("name", TABLES)
def test_updates_equal_a_dense_decomposition(name):
    x = TABLES[name]
    spectrum, first, rest = Spectrum(x.shape[1]), Spectrum(x.shape[1]), Spectrum(x.shape[1])
    for i, row in enumerate(x):
        spectrum.add(row)
        (first if i % 3 else rest).add(row)
    first.merge(rest)
    blocks = Spectrum(x.shape[1])
    blocks.add_rows(x[: len(x) // 2])
    blocks.add_rows(x[len(x) // 2 :])
    want, scale = scatter(x), max(np.abs(scatter(x)).max(), 1.0)
    for s in (spectrum, first, blocks):
        assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0)) and np.all(np.diff(s.values) >= 0)
        assert np.abs(s.vectors * s.values @ s.vectors.T - want).max() < 1e-10 * scale
        assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-10


def plain(rows, components=16):
    x = {i: [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for i, v in enumerate(rows) if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    size = max(map(len, x.values()))
    x = {i: v + [1_000_000] * (size - len(v)) for i, v in x.items()}
    fit = [list(v) for v in sorted(set(map(tuple, x.values())))]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit], np.float64) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = [i for i in np.argsort(-values) if values[i] > values.max() * 1e-12][:components]
    out = {}
    for i, v in x.items():
        exact = [n * a - s for a, s in zip(v, sums, strict=True)]
        for k, j in enumerate(order, 1):
            out[i, k] = (n, sum(e * e for e in exact), float(np.array(exact, np.float64) / n @ vectors[:, j] / np.sqrt(values[j])), values[j] / np.trace(y.T @ y / n))
    return out


def compare(got, want, tolerance=1e-6):
    assert len(got) == len(want)
    sign = {}
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained, rel=1e-4) and r.identity_error <= 1e-4
        if abs(whitened) > 1e-3:
            sign.setdefault(r.component, np.sign(whitened) == np.sign(r.whitened))
        assert r.whitened == pytest.approx(whitened if sign.get(r.component, True) else -whitened, abs=tolerance)


def test_rows_equal_a_dense_decomposition(spark):
    vectors = [v.tolist() for v in RNG.normal(size=(150, 20)) * RNG.uniform(0.2, 3, 20)]
    vectors += [None, [1.0, None, *[0.0] * 18], [float("nan")] * 20, [float("inf")] * 20, vectors[0], vectors[0], [0.5] * 7]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, x string, n int").repartition(5)
    got = whitening.whiten(df).collect()
    assert got[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got, plain(vectors))


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).collect() == [] and whitening.whiten(make([(1, None)])).collect() == []
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == [] and whitening.whiten(make([(1, [])])).collect() == []
    got = whitening.whiten(make([(1, [1.0, 0.0]), (None, [1.0, 2.0]), (1, [1.0, 0.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in sorted(got, key=lambda r: r.vec_id or 0)] == [(None, 1, 2, 16384), (1, 1, 2, 16384), (1, 1, 2, 16384)]
    huge = whitening.whiten(make([(1, [1e30, 1.0]), (2, [-1e30, 5.0]), (3, [0.0, 2.0])])).collect()
    assert len(huge) == 3 and all(r.deviation is None for r in huge if r.vec_id != 3)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    at = {r.vec_id: i for i, r in enumerate(rows)}
    assert len(at) == len(rows)
    got = queries.op12_whitening(spark, sf_dir).collect()
    want = plain([r.embedding for r in rows])
    compare(got, {(rows[i].vec_id, k): v for (i, k), v in want.items()})
