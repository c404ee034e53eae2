"""Minority oversampling between nearest neighbours (Chawla et al., 2002), exact neighbours at scale.

Neighbour search is a pruned join of packs: rows are placed with their nearest pivot, and the rows of a pivot are stored in
packs of bounded size. Every pack meets every other where both are read from storage, so nothing is shuffled but the k best of
a row per task; a query leaves out a pack that the triangle inequality rules out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.operators.ordering import rank_by_hash, seeded_order
from threatlake.session import cut_lineage, spread

#: Rows of a pack at least, rows of a pack that are compared at once, and pairs whose exact distance is worked out at once.
PACK_ROWS, QUERY_ROWS, PAIRS = 4096, 256, 65_536


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _exact(q: np.ndarray, t: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of the pairs (r, c), without the rounding of the expanded square, so copies lie at exactly 0."""
    parts = [np.sqrt(((q[r[i:i + PAIRS]] - t[c[i:i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(r), PAIRS)]
    return np.concatenate(parts) if parts else np.empty(0)


def _improve(q: np.ndarray, names: np.ndarray, best: np.ndarray, held: np.ndarray, t: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k best of each query among those held and the rows ``t``, nearest first, ties by id."""
    k = best.shape[1]
    sizes = (q * q).sum(1), (t * t).sum(1)
    square = sizes[0][:, None] + sizes[1][None, :] - 2.0 * q @ t.T
    square[names[:, None] == others[None, :]] = np.inf
    limit = best[:, -1] ** 2
    if not np.isfinite(limit).all() and len(t) > k:
        limit = np.minimum(limit, np.partition(square, k - 1, axis=1)[:, k - 1])
    near = (square <= (limit + 1e-12 * (sizes[0] + sizes[1].max()))[:, None]) & np.isfinite(square)
    r, c = np.nonzero(near)
    d = _exact(q, t, r, c)
    order = np.lexsort((others[c], d, r))
    r, c, d = r[order], c[order], d[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    take = place < k
    both = np.full((len(q), 2 * k), np.inf)
    ids = np.zeros((len(q), 2 * k), np.int64)
    both[:, :k], ids[:, :k] = best, held
    both[r[take], k + place[take]], ids[r[take], k + place[take]] = d[take], others[c[take]]
    first = np.lexsort((ids, both), axis=1)[:, :k]
    return np.take_along_axis(both, first, 1), np.take_along_axis(ids, first, 1)


def nearest_neighbours(
    df: DataFrame, id_col: str, vector: str, k: int = 5, pivots: int = 64, block: int = 4096, seed: int = 42,
) -> DataFrame:
    """(id, neighbour, distance, place): the k nearest other rows of every row; ties by id, rows without an id are left out.

    ``vector`` is array<double>. Pivots (at most ``pivots`` rows) and their summary are the only things held by every task;
    a pack has ``block`` rows at most, small blocks ``PACK_ROWS``. Storage grows with the rows, shuffled rows with k, the rows
    and the square root of the cores; the distances are quadratic, those that pivots and the best so far rule out apart.
    """
    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("id IS NOT NULL")
    order = seeded_order(F.col("id"), seed=seed)
    chosen = rank_by_hash(base, [], order, first=pivots).orderBy("rn").select("x").toPandas()
    if chosen.empty:
        return base.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(1).alias("place")).limit(0)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(_matrix(chosen["x"]))

    def place(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(_matrix(pdf["x"]), shared.value)
                yield pdf.assign(pivot=d.argmin(1).astype("int32"), reach=d.min(1))

    placed = cut_lineage(spread(base).mapInPandas(place, "id bigint, x array<double>, pivot int, reach double"))
    size = max(block, PACK_ROWS)
    summary = placed.groupBy("pivot").agg(
        F.count("*").alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high"), F.ceil(F.count("*") / size).alias("parts"))
    table = summary.toPandas()
    blocks = spark.sparkContext.broadcast(table)

    def limits(x: np.ndarray) -> np.ndarray:
        """An upper bound of the distance of each row's k-th neighbour: as many rows lie with the pivots of the least farthest rows."""
        s = blocks.value
        upper = _distances(x, shared.value)[:, s["pivot"].to_numpy()] + s["high"].to_numpy()
        nearest_first = np.argsort(upper, axis=1)
        held = np.cumsum(s["n"].to_numpy()[nearest_first], axis=1)
        enough = np.minimum((held < k + 1).sum(1), len(s) - 1)
        bound = upper[np.arange(len(x)), nearest_first[np.arange(len(x)), enough]]
        return np.where(held[:, -1] < k + 1, np.inf, bound * (1 + 1e-9) + 1e-6)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = _matrix(pdf["x"])
        return pd.DataFrame({"pivot": [pdf["pivot"].iloc[0]], "part": [pdf["part"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()],
                             "low": [pdf["reach"].min()], "high": [pdf["reach"].max()], "limits": [limits(x).tobytes()]})

    parts = summary.select("pivot", "parts")
    dealt = placed.withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(parts), "pivot").withColumn("part", F.pmod("_at", "parts"))
    packs = dealt.groupBy("pivot", "part").applyInPandas(
        pack, "pivot int, part bigint, ids binary, x binary, low double, high double, limits binary")
    tasks = min(int(table["parts"].sum()), math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)))
    stored = cut_lineage(packs.repartition(tasks)).rdd
    width = len(chosen["x"].iloc[0])

    def search(pairs):
        state = {}
        for a, b in pairs:
            key = a.pivot, a.part
            if key not in state:
                names, x = np.frombuffer(a.ids, np.int64), np.frombuffer(a.x).reshape(-1, width)
                state[key] = [names, x, np.frombuffer(a.limits), np.full((len(names), k), np.inf), np.zeros((len(names), k), np.int64)]
            names, x, limit, best, held = state[key]
            others, t = np.frombuffer(b.ids, np.int64), np.frombuffer(b.x).reshape(-1, width)
            from_pivot = _distances(x, shared.value[b.pivot:b.pivot + 1])[:, 0]
            lower = np.maximum(from_pivot - b.high, b.low - from_pivot)
            some = np.flatnonzero(lower <= np.minimum(limit, best[:, -1] * (1 + 1e-9) + 1e-6))
            for start in range(0, len(some), QUERY_ROWS):
                rows = some[start:start + QUERY_ROWS]
                best[rows], held[rows] = _improve(x[rows], names[rows], best[rows], held[rows], t, others)
        for names, _, _, best, held in state.values():
            r, c = np.nonzero(np.isfinite(best))
            for start in range(0, len(r), PAIRS):
                i, j = r[start:start + PAIRS], c[start:start + PAIRS]
                yield names[i].tolist(), held[i, j].tolist(), best[i, j].tolist()

    found = spark.createDataFrame(
        stored.cartesian(stored).mapPartitions(search), "id array<bigint>, neighbour array<bigint>, distance array<double>", verifySchema=False)
    candidates = found.select(F.inline(F.arrays_zip("id", "neighbour", "distance")))
    best = candidates.groupBy("id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("_near"))
    return best.select("id", F.posexplode("_near").alias("place", "_n")).select(
        "id", "_n.neighbour", "_n.distance", (F.col("place") + 1).alias("place"))


def oversample(
    df: DataFrame, id_col: str, vector: str, label: str, minority, wanted: int, k: int = 5, seed: int = 42,
) -> DataFrame:
    """``wanted`` synthetic minority rows (id, vector, label): points between a row and one of its neighbours."""
    rare = df.filter(F.col(label) == minority)
    near = nearest_neighbours(rare, id_col, vector, k, seed=seed)
    vectors = rare.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    size = vectors.count()
    if size < 2:
        raise ValueError("a minority of at least two rows is needed")
    each, rest = divmod(wanted, size)
    ranked = rank_by_hash(vectors, [], seeded_order(F.col("id"), seed=seed))
    copies = F.lit(each) + F.when(F.col("rn") <= rest, 1).otherwise(0)
    seeds = ranked.withColumn("copies", copies).filter(F.col("copies") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "copy"), 1) / F.lit(2.0**63)
    choice = (F.pmod(F.xxhash64(F.lit(seed + 1), "id", "copy"), F.lit(min(k, size - 1))) + 1).cast("int")
    drawn = seeds.withColumns({"gap": unit, "place": choice})
    other = vectors.select(F.col("id").alias("neighbour"), F.col("x").alias("y"))
    joined = drawn.join(near.select("id", "place", "neighbour"), ["id", "place"]).join(other, "neighbour")
    point = F.zip_with("x", "y", lambda a, b: a + F.col("gap") * (b - a))
    return joined.select(
        F.concat_ws("-", F.lit("synthetic"), "id", "copy").alias(id_col), point.alias(vector), F.lit(minority).alias(label))
