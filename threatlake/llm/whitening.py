"""Whitening of embeddings: principal components from spectra that the partitions grow row by row and that are merged in a tree."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.llm.spectrum import Spectrum
from threatlake.llm.storage import cut_lineage, kept

#: Steps of a unit and the number that stands for zero; components at most.
SCALE, ZERO, COMPONENTS = 64, 1_000_000, 16
#: States merged by one task, and the least share of the largest eigenvalue that counts as variance.
FAN_IN, LEAST = 16, 1e-12
#: Stepped entries end here, so that every one is exact as a double (entries of embeddings beyond 2**46).
EDGE = 1 << 52


def whole_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x array<bigint>) of the rows whose vector is there, without null and non-finite entries; entries in whole steps."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    step = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(float(-EDGE))), F.lit(float(EDGE)))) + ZERO
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).alias("vec_id"), F.transform(v, step).alias("x"))


def _padded(x: Column, size: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(ZERO).cast("bigint"), F.greatest(F.lit(size) - F.size(x), F.lit(0))))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(x - sums/n as doubles, n*x - sums as whole numbers), subtracted in whole numbers before anything is rounded."""
    if len(x) and float(np.abs(x).max()) * n + max(map(abs, sums)) < 2**62:
        exact = x * n - np.array(sums, np.int64)
    else:
        exact = x.astype(object) * n - np.array(sums, object)
    return exact.astype(np.float64) / n, exact


def _states(df: DataFrame, column: str, make: Callable[[], tuple[Callable[[pa.Array], None], Callable[[], object]]]) -> DataFrame:
    """(part, state): one pickled state per partition of ``df``, from ``make``'s pair of a batch taker and a result."""

    def run(batches: Iterator[pa.RecordBatch]):
        take, result = make()
        part = None
        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) else part
            take(batch.column(column))
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickle.dumps(result())], pa.binary())], names=["part", "state"])

    return df.select(F.spark_partition_id().cast("long").alias("part"), column).mapInArrow(run, "part long, state binary")


def _merged(states: DataFrame, merge: Callable[[object, object], object]) -> object:
    """All states in one: ``FAN_IN`` neighbours at a time, in the order of their parts, so reruns agree; None where there are none."""

    def fold(key, rows):
        out = None
        for state in rows.sort_values("part")["state"]:
            state = pickle.loads(state)
            out = state if out is None else merge(out, state)
        return pd.DataFrame({"part": [key[0]], "state": [pickle.dumps(out)]})

    states = cut_lineage(states)
    last = states.agg(F.max("part").alias("last")).first().last
    while last:
        states = cut_lineage(states.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(fold, "part long, state binary"))
        last //= FAN_IN
    found = states.first()
    return pickle.loads(found.state) if found else None


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: number and sums of the different vectors, eigenvalues (falling) and vectors (columns) of the components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def size(self) -> int:
        return len(self.sums)


def fit(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fits the components to the different stepped vectors, each once; None where no vector is left.

    Every partition takes its vectors into a spectrum of their centred outer products by rank-one updates, spectra meet in a tree,
    and one more pass over all vectors solves the eigenproblem anew in the basis found so far (Rayleigh-Ritz), centred by the
    exact means. The last pass measures the whitened covariance. A state has the size of the covariance matrix, whatever the rows.
    """
    stepped = whole_vectors(rows, vec_id, vector)
    size = stepped.agg(F.max(F.size("x")).alias("size")).first()["size"]
    if not size:
        return None
    different = kept(stepped.select(_padded(F.col("x"), size).alias("x")).distinct(), "vectors")

    def grow():
        spectrum, sums, base = Spectrum(size), [0] * size, np.zeros(size)

        def take(column):
            nonlocal base
            x = _matrix(column, size)
            if not len(x):
                return
            if not spectrum.n:
                base = x[0].astype(np.float64)
            for i, s in enumerate((x.sum(axis=0) if float(np.abs(x).max()) * len(x) < 2**62 else x.astype(object).sum(axis=0)).tolist()):
                sums[i] += int(s)
            spectrum.add_rows(x.astype(np.float64) - base)

        def result():
            spectrum.mean = spectrum.mean + base
            return sums, spectrum
        return take, result

    def join(a, b):
        a[1].merge(b[1])
        return [x + y for x, y in zip(a[0], b[0], strict=True)], a[1]

    sums, spectrum = _merged(_states(different, "x", grow), join)
    n, basis = spectrum.n, np.linalg.qr(spectrum.vectors)[0]

    def products(project: np.ndarray):
        def make():
            total = np.zeros((project.shape[1],) * 2)
            spread = np.zeros(1)

            def take(column):
                y = _centred(_matrix(column, size), n, sums)[0]
                spread[0] += (y * y).sum()
                y = y @ project
                total[:] += y.T @ y
            return take, lambda: (total, spread)
        return _merged(_states(different, "x", make), lambda a, b: (a[0] + b[0], a[1] + b[1]))

    inner, spread = products(basis)
    values, turn = np.linalg.eigh(inner / n)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0.0) * LEAST]
    values, vectors = values[order], basis @ turn[:, order]
    if len(order):
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
        off = products(vectors / np.sqrt(values))[0] / n - np.eye(len(order))
    return Whitening(n, sums, values, vectors, float(spread[0]) / n, float(np.abs(off).max()) if len(order) else 0.0)


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, model: Whitening | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per vector and component, from 1 by falling variance.

    Rows whose vector is null or holds null or non-finite entries are left out. Equal rows give equal results, null ids stay null.
    Vectors of unlike lengths are read as filled up with zeros. Directions without variance (below 1e-12 of the largest) have no
    whitened value and no row, so equal vectors alone, or one vector, give no rows, and neither does an empty table. ``deviation`` is null
    where it exceeds a long; entries beyond 2**46 are taken as that. Only the two columns named are looked at. A component's sign makes
    its largest entry positive. ``model`` applies an earlier fit; longer vectors than it knows are then cut to its length.
    """
    stepped = whole_vectors(rows, vec_id, vector)
    id_type = stepped.schema["vec_id"].dataType.simpleString()
    model = model or fit(rows, vec_id, vector, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], f"vec_id {id_type}, {SCHEMA}")
    size, k = model.size, len(model.values)
    project, share = model.vectors / np.sqrt(model.values), model.values / model.trace
    n, sums, error = model.n, model.sums, model.identity_error

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                centred, exact = _centred(_matrix(part.column("x"), size), n, sums)
                if exact.dtype == object or float((exact.astype(np.float64) ** 2).sum(axis=1).max()) >= 2**62:
                    exact = exact.astype(object)
                deviation = [d if d < 2**63 else None for d in map(int, (exact * exact).sum(axis=1))]
                m = len(part)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array((centred @ project).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    x = F.slice(_padded(F.col("x"), size), 1, size)
    return stepped.select("vec_id", x.alias("x")).mapInArrow(run, f"vec_id {id_type}, {SCHEMA}")
