"""Nearest neighbours by inner product over several Hilbert orderings of projected vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatlake.llm.cosine import stacked, usable
from threatlake.llm.storage import cut_lineage
from threatlake.llm.text import map_rows

#: Orderings, projected dimensions, bits a dimension, key segments of an ordering, bound of the sample that places
#: projections and segments, and candidate rows of a task.
CURVES, DIMS, DEPTH, SEGMENTS, SAMPLE, CHUNK = 20, 8, 6, 32, 20_000, 32_768


def hilbert_keys(cells: np.ndarray, depth: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below 2 ** depth; dims * depth <= 62."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (depth - 1)
    while q > 1:  # undo the rotations of the curve, from the coarsest level down
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (depth - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class Orderings:
    """Random projections, each with its own shift, and the segment bounds of each ordering, from a bounded sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, depth: int = DEPTH, segments: int = SEGMENTS, seed: int = 42):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.depth, self.curves = depth, curves
        self.center = sample.mean(axis=0) if len(sample) else np.zeros(width)
        self.axes = rng.standard_normal((curves, width, dims))
        for i in range(curves):
            base, _ = np.linalg.qr(self.axes[i])
            self.axes[i, :, : base.shape[1]] = base
        placed = (sample - self.center) @ self.axes if len(sample) else np.zeros((curves, 1, dims))
        self.scale = placed.std(axis=1) + 1e-12
        self.shift = rng.uniform(-0.25, 0.25, (curves, dims))
        keys = np.sort(self.keys(sample), axis=0) if len(sample) else np.zeros((1, curves), np.int64)
        bounds = keys[(np.arange(1, segments) * len(keys)) // segments].T
        self.bounds = [np.unique(b[b > low]) for b, low in zip(bounds, keys[0], strict=True)]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, curves)."""
        out = []
        for i in range(self.curves):
            z = ((vectors - self.center) @ self.axes[i]) / self.scale[i] + self.shift[i]
            cells = np.clip(((z + 3) * ((1 << self.depth) / 6)).astype(np.int64), 0, (1 << self.depth) - 1)
            out.append(hilbert_keys(cells, self.depth))
        return np.stack(out, axis=1)

    def segments(self, vectors: np.ndarray) -> np.ndarray:
        keys = self.keys(vectors)
        return np.stack([np.searchsorted(self.bounds[i], keys[:, i], side="right") for i in range(self.curves)], axis=1)


def windows(held: dict[int, int], least: int) -> dict[int, tuple[int, int]]:
    """(first, last) segment to look through from each segment: itself and one on both sides, and more of them, the emptier side
    first, until ``least`` ids are held or the whole ordering. ``held`` has the ids of each segment that has rows."""
    segs, out = sorted(held), {}
    total = np.concatenate([[0], np.cumsum([held[s] for s in segs])])
    for i, seg in enumerate(segs):
        a, b = max(i - 1, 0), min(i + 2, len(segs))
        while total[b] - total[a] < least and (a or b < len(segs)):
            if b == len(segs) or (a and total[i] - total[a] <= total[b] - total[i + 1]):
                a -= 1
            else:
                b += 1
        out[seg] = segs[a], segs[b - 1]
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", curves: int = CURVES,
            dims: int = DIMS, depth: int = DEPTH, segments: int = SEGMENTS, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each row whose id is divisible by ``every``.

    Each ordering is range-partitioned into segments of equal share of the sample, of ``k`` sampled rows at least; a query looks through its
    own and the two neighbouring segments of every ordering, so its window is a fixed share of the table, and through further ones until
    ``k`` other ids are in sight or the whole ordering is. Candidates are ranked by the
    double-precision inner product of the original vectors, ties to the smaller id; all candidates of a query that ties reach
    are compared. Segments are cut into chunks, so a task holds a bounded number of candidates. Vectors that are null, empty,
    zero or not finite, and null ids, take no part; vectors of another length than most of the sample do not either. A repeated
    id counts once, by its nearest row, and a query asks once for each different row of its id. The sample (lowest id hashes)
    only places projections and segment bounds; every row is indexed.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull()).distinct()
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    lengths = [len(r.v) for r in drawn]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 1
    orderings = Orderings(np.array([r.v for r in drawn if len(r.v) == width], np.float64).reshape(-1, width), curves, dims, depth, max(1, min(segments, len(drawn) // k)))
    shared = vectors.sparkSession.sparkContext.broadcast(orderings)
    rows = rows.where(F.size("v") == width)

    def make():
        def work(batch):
            return {"seg": list(shared.value.segments(np.array(batch["v"], np.float64).reshape(-1, width)).astype(np.int32))}
        return work

    placed = map_rows(rows.withColumn("x", F.col("v")).select("id", F.col("x").alias("w"), "v"), {"seg": "array<int>"}, ["id", "w"], make)
    placed = cut_lineage(placed.withColumnRenamed("w", "v"))
    parts = F.greatest(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
    one = placed.select("id", "v", F.posexplode("seg").alias("curve", "seg"))
    sizes = cut_lineage(one.groupBy("curve", "seg").agg(F.count("*").alias("n")).withColumn("parts", parts).drop("n"))
    base = one.join(sizes, ["curve", "seg"]).select("curve", "seg", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"),
                                                    F.lit(False).alias("query"), "id", "v")
    asked = placed.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", F.posexplode("seg").alias("curve", "own"))
    # an id with rows in several segments counts in the first of them, so no window is taken for fuller than it is
    owned = one.groupBy("curve", "id").agg(F.min("seg").alias("seg")).groupBy("curve", "seg").agg(F.count("*").alias("n"))
    held: dict[int, dict[int, int]] = {}
    for r in sizes.join(owned, ["curve", "seg"], "left").select("curve", "seg", F.coalesce("n", F.lit(0)).alias("n")).collect():
        held.setdefault(r.curve, {})[r.seg] = r.n
    seen = [(c, own, *map(int, ends)) for c, h in held.items() for own, ends in windows(h, k + 1).items()]
    seen = vectors.sparkSession.createDataFrame(seen, "curve int, own int, low int, high int")
    asked = asked.join(seen, ["curve", "own"]).select("id", "v", "curve", F.explode(F.sequence("low", "high")).alias("seg")).join(sizes, ["curve", "seg"])
    asked = asked.select("curve", "seg", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("query"), "id", "v")
    dealt = base.union(asked).repartition("curve", "seg", "part").sortWithinPartitions("curve", "seg", "part", "query")

    def search(batches):
        names = ["query_id", "vec_id", "score"]
        key, ids, held = None, [], []
        sealed = None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("curve", "seg", "part", "query")], axis=1)
            if not len(where):
                continue
            change = np.flatnonzero((np.diff(where, axis=0) != 0).any(axis=1)) + 1
            all_ids, all_v = batch.column("id").to_numpy(), stacked(batch.column("v"))
            out = []
            for a, b in zip([0, *change], [*change, len(where)], strict=True):
                group, is_query = tuple(where[a, :3]), where[a, 3]
                if group != key:
                    key, ids, held, sealed = group, [], [], None
                if not is_query:
                    ids.append(all_ids[a:b])
                    held.append(all_v[a:b])
                elif ids:
                    if sealed is None:
                        of = np.concatenate(ids)
                        order = np.argsort(of, kind="stable")
                        sealed = of[order], np.concatenate(held)[order]
                    for s in range(a, b, 256):
                        out.append(_best(all_ids[s : min(s + 256, b)], all_v[s : min(s + 256, b)], *sealed, k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=names)

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(query_ids, queries, ids, vectors, k):
    """Rows of each query that may be among its k nearest ids of this chunk, the best row of each id, with scores summed row by row,
    alike for equal vectors. ``ids`` are in order."""
    rough = queries @ vectors.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    by_id = rough if len(begin) == len(ids) else np.maximum.reduceat(rough, begin, axis=1)
    n = by_id.shape[1]
    cut = np.partition(by_id, n - k, axis=1)[:, n - k] if n > k else np.full(len(rough), -np.inf)
    row, column = np.nonzero((rough >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None]) & np.isfinite(rough))
    exact = (queries[row] * vectors[column]).sum(axis=1)
    if len(begin) < len(ids):
        order = np.lexsort((-exact, ids[column], row))
        row, column, exact = row[order], column[order], exact[order]
        best = np.append(True, (row[1:] != row[:-1]) | (ids[column[1:]] != ids[column[:-1]]))[: len(row)]
        row, column, exact = row[best], column[best], exact[best]
    order = np.lexsort((ids[column], -exact, row))
    row, column, exact = row[order], column[order], exact[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return query_ids[row[keep]], ids[column[keep]], exact[keep]
