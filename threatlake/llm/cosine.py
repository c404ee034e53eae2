"""Near-duplicate vectors: random-hyperplane tables, exact cosines, connected components."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.llm.components import connected_components
from threatlake.llm.storage import cut_lineage

#: Least sign bits of a table, different vectors of a label that a code holds on average beyond that, the chance that a
#: pair exactly at the threshold shares no table, and vectors compared at a time.
BITS, CROWD, MISS, BLOCK = 10, 64, 1e-4, 2048


def bits_needed(rows: int, crowd: int = CROWD, least: int = BITS) -> int:
    """Sign bits at which unrelated vectors share a code with about ``crowd`` others, however many rows there are."""
    return min(30, max(least, math.ceil(math.log2(max(rows, 1) / crowd))))


def tables_needed(threshold: float, bits: int = BITS, miss: float = MISS) -> int:
    """Tables after which a pair at the threshold has met nowhere with probability ``miss`` at most."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-same))


@functools.lru_cache(4)
def planes(dim: int, tables: int, bits: int, seed: int = 42) -> np.ndarray:
    """Normals of the random hyperplanes, (dim, tables * bits)."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def signatures(vectors: np.ndarray, tables: int, bits: int, seed: int = 42, first: int | None = None) -> np.ndarray:
    """Sign codes, (vectors, tables); ``first``: of that many tables only."""
    some = tables if first is None else first
    signs = (vectors @ planes(vectors.shape[1], tables, bits, seed)[:, : some * bits]) > 0
    return signs.reshape(len(vectors), some, bits) @ (1 << np.arange(bits))


def usable(vector: Column) -> Column:
    """True for a vector with components that are all present and finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def stacked(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as a matrix in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def block_links(left: tuple, right: tuple | None, table: int, threshold: float, codes):
    """Links of one pair of blocks that no earlier table shows: weights linked to each side, and a chain of links.

    A side is (positions, unit vectors, weights); ``right`` None compares a block with itself. ``codes`` gives the sign
    codes of vectors in the tables before this one; it is asked for vectors with a link only.
    """
    own = right is None
    right = left if own else right
    close = left[1] @ right[1].T >= threshold
    if own:
        np.fill_diagonal(close, False)
    if table and close.any():
        at = np.ix_(np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0)))
        some, a = close[at], codes(left[1][at[0][:, 0]])
        b = codes(right[1][at[1][0]])
        for t in range(table):
            some &= a[:, t][:, None] != b[:, t][None, :]
        close[at] = some
    to_left = close @ right[2]
    to_right = None if own else left[2] @ close
    chain = [(left[0][i], right[0][j]) for i, j in _chain(close, own)]
    return to_left, to_right, chain


def _chain(close: np.ndarray, own: bool) -> list[tuple[int, int]]:
    """A few (row, column) links that connect all that the matrix connects: at most one fewer than rows plus columns."""
    rows, out = close.any(axis=1), []
    seen = np.zeros(close.shape[1], bool)
    left = rows.copy()
    while left.any():
        i = int(np.argmax(left))
        left[i] = False
        group_rows = [i]
        while group_rows:
            r = group_rows.pop()
            fresh = close[r] & ~seen
            linked = np.flatnonzero(fresh)
            seen |= fresh
            out += [(r, int(c)) for c in linked]
            if own:
                nxt = linked[left[linked]]
            elif len(linked):
                nxt = np.flatnonzero(close[:, linked].any(axis=1) & left)
                out += [(int(x), int(linked[np.argmax(close[x, linked])])) for x in nxt]
            else:
                nxt = linked
            left[nxt] = False
            group_rows += nxt.tolist()
    return out


def similar_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = 0.93, bits: int | None = None, miss: float = MISS, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; only vectors of equal label that is not null are compared.

    Equal vectors of a label are one class, searched once and counted as often as they occur; classes meet where
    they share a sign code in some table, and every pair that meets is checked by its cosine in double precision.
    A pair counts in the first table that it shares. Without ``bits``, codes get longer with the different vectors of the
    largest label, and the tables more, so that a code holds about ``CROWD`` unrelated ones at every size. Codes held by more classes than ``block`` are cut into blocks
    and compared block by block; a block emits counts and a chain of links, never its pairs. Vectors that are
    null, empty, zero or not finite, or whose label is null, link with nothing. Vectors of unlike length are never
    compared. Repeated rows are vectors of their own. A null id is carried through and never names a component.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    good = usable(F.col("v")) & F.col("label").isNotNull()
    classes = cut_lineage(rows.where(good).groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
                          .withColumn("pos", F.monotonically_increasing_id()))
    if bits is None:
        bits = bits_needed(classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    tables = tables_needed(threshold, bits, miss)

    def code(batches):
        for batch in batches:
            pos, label_, v, weight = (batch.column(c) for c in ("pos", "label", "v", "weight"))
            lengths = v.value_lengths().to_numpy()
            for dim in np.unique(lengths):
                at = pa.array(np.flatnonzero(lengths == dim))
                x = unit(stacked(v.take(at)))
                codes, n = signatures(x, tables, bits, seed).astype(np.int32), len(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(pos.take(at).to_numpy(), tables), pa.int64()),
                    pa.array(np.repeat(label_.take(at).cast(pa.string()).to_numpy(zero_copy_only=False), tables), pa.string()),
                    pa.array(np.full(n * tables, dim), pa.int32()), pa.array(np.tile(np.arange(tables), n), pa.int32()),
                    pa.array(codes.ravel(), pa.int32())], names=["pos", "label", "dim", "t", "code"])

    coded = cut_lineage(classes.select("pos", "label", "v", "weight").mapInArrow(code, "pos long, label string, dim int, t int, code int"))
    key = ["label", "dim", "t", "code"]
    crowd = coded.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    held = classes.select("pos", "v", "weight")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("pos"), blocks).cast("int")
    met = coded.join(crowd, key).withColumn("blocks", blocks).withColumn("own", own)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "pos", *key, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    dealt = met.join(held, "pos").repartition(*key, "lo", "hi").sortWithinPartitions(*key, "lo", "hi", "own").select(
        *key, "lo", "hi", "own", "pos", "v", "weight")

    def compare(batches):
        names = ["a", "b", "links"]

        def emit(table, parts):
            pos, own_, x, w = (np.concatenate([p[i] for p in parts]) for i in range(4))
            lo, hi = parts[0][4], parts[0][5]
            x = unit(x)
            codes = lambda v: signatures(v, tables, bits, seed, table)
            side = lambda m: (pos[m], x[m], w[m].astype(np.float64))
            if lo == hi:
                counts, _, chain = block_links(side(own_ == lo), None, table, threshold, codes)
                found = [(pos[own_ == lo], counts)]
            else:
                left, right, chain = block_links(side(own_ == lo), side(own_ == hi), table, threshold, codes)
                found = [(pos[own_ == lo], left), (pos[own_ == hi], right)]
            a = np.concatenate([p for p, _ in found])
            n = np.concatenate([c for _, c in found])
            some = n > 0
            left_ids, right_ids = np.array(chain, np.int64).reshape(-1, 2).T
            return (np.concatenate([a[some], left_ids]), np.concatenate([np.full(some.sum(), -1), right_ids]),
                    np.concatenate([n[some].astype(np.int64), np.zeros(len(chain), np.int64)]))

        last, parts = None, []
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            ints = {c: columns[c].to_numpy() for c in ("dim", "t", "code", "lo", "hi", "own", "pos", "weight")}
            labels = columns["label"].dictionary_encode()
            kind = labels.indices.to_numpy()
            names_ = labels.dictionary.to_pylist()
            if not len(kind):
                continue
            change = np.flatnonzero(np.any([np.diff(z) != 0 for z in (kind, *(ints[c] for c in ("dim", "t", "code", "lo", "hi")))], axis=0)) + 1
            out = []
            for a, b in zip([0, *change], [*change, len(kind)], strict=True):
                here = (names_[kind[a]], *(int(ints[c][a]) for c in ("dim", "t", "code", "lo", "hi")))
                if here != last:
                    if parts:
                        out.append(emit(last[2], parts))
                    last, parts = here, []
                parts.append((ints["pos"][a:b], ints["own"][a:b], stacked(columns["v"].slice(a, b - a)), ints["weight"][a:b], here[4], here[5]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], names=names)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in emit(last[2], parts)], names=names)

    found = cut_lineage(dealt.mapInArrow(compare, "a long, b long, links long"))
    counts = found.where("b < 0").groupBy(F.col("a").alias("pos")).agg(F.sum("links").alias("links"))
    ids = classes.select("pos", "first_id")
    groups = connected_components(found.where("b >= 0").select("a", "b"), "a", "b").withColumnRenamed("node", "pos")
    placed = ids.join(groups, "pos", "left").withColumn("component", F.coalesce("component", "pos"))
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = placed.join(smallest, "component").select("pos", "component_id")
    info = classes.select("pos", "label", "v", "weight").join(of_class, "pos").join(counts, "pos", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = rows.where(good).join(info, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
