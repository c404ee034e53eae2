"""Random forests of large tables: splits of large nodes from histograms that tasks add up, subtrees of smaller ones finished by single tasks.

The trees follow Spark's forest: weighted split candidates, a Poisson bag per tree, the square root of the features drawn per node, Gini
impurity of weighted classes, siblings of one prediction merged, leaf shares averaged over the trees. Its random draws are others.
"""

from __future__ import annotations

import heapq
import json
import math
import mmap
import uuid
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.ml.boosting import binned_rows
from threatlake.session import checkpoint_folder, cut_lineage

BINS, CLASSES = 256, 100  # a bin is one byte; Spark's forest takes as many classes
#: Bagged rows of a node up to which one task finishes its subtree, cells that a task looks through at once, and bytes of the histograms of a pass.
LOCAL_ROWS, CELLS, TABLE_BYTES = 1 << 20, 1 << 20, 64 << 20
#: Rows that are condensed together into points of their weighted distribution, per feature.
SKETCH_ROWS, SKETCH_POINTS = 65_536, 2_048
#: Gains up to this are rounding errors.
LEAST_GAIN = 1e-15


def condensed(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values and their weights; of more than ``points``, the first and last of each slice of equal weight, with what lies between them."""
    values, place = np.unique(values, return_inverse=True)
    weights = np.bincount(place, weights, len(values))
    if len(values) <= points:
        return values, weights
    upto = np.cumsum(weights)
    part = np.minimum((upto - weights / 2) / upto[-1] * points, points - 1).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    kept = np.union1d(first, np.append(first[1:], len(values)) - 1)
    return values[kept], np.diff(upto[kept], prepend=0.0)


def weighted_cuts(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """The midpoints that cut the weight into ``bins`` parts as even as the values allow; all midpoints if there are no more."""
    values, weights = condensed(values, weights, len(values) + 1)
    middle = values[:-1] / 2 + values[1:] / 2
    if len(middle) < bins:
        return middle
    upto = np.cumsum(weights)
    target = upto[-1] * np.arange(1, bins) / bins
    above = np.clip(np.searchsorted(upto, target), 1, len(middle))
    return middle[np.unique(np.minimum(np.where(target - upto[above - 1] <= upto[above] - target, above - 1, above), len(middle) - 1))]


def feature_cuts(rows: DataFrame, width: int, weights: np.ndarray, bins: int) -> list[np.ndarray]:
    """Split candidates of the columns f0, f1, ... from the whole table; a block of rows is exact up to 1 / ``SKETCH_POINTS`` of its weight."""

    def sketch(frames):
        held, n = [], 0

        def points():
            x, y = (np.concatenate(p) for p in zip(*held, strict=True))
            made = [condensed(x[:, i], weights[y], SKETCH_POINTS) for i in range(width)]
            return pd.DataFrame({"f": np.arange(width, dtype=np.int32), "v": [v.tobytes() for v, _ in made], "w": [w.tobytes() for _, w in made]})

        for f in frames:
            held.append((f.iloc[:, :width].to_numpy(np.float64), f["y"].to_numpy()))
            n += len(f)
            if n >= SKETCH_ROWS:
                yield points()
                held, n = [], 0
        if n:
            yield points()

    def cuts(f):
        v, w = (np.concatenate([np.frombuffer(b) for b in f[c]]) for c in "vw")
        return pd.DataFrame({"f": f["f"].iloc[:1], "cuts": [weighted_cuts(v, w, bins).tolist()]})

    made = rows.mapInPandas(sketch, "f int, v binary, w binary").groupBy("f").applyInPandas(cuts, "f int, cuts array<double>")
    found = {r.f: np.array(r.cuts, np.float64) for r in made.collect()}
    return [found[i] for i in range(width)]


def bag(seed: int, tree: int, block: int, n: int, bootstrap: bool = True) -> np.ndarray:
    """How often a tree draws each row of a block."""
    return np.random.default_rng([seed, tree, block]).poisson(1.0, n).astype(np.uint8) if bootstrap else np.ones(n, np.uint8)


def subsets(rng: np.random.Generator, nodes: int, width: int, some: int) -> np.ndarray:
    """Features that each node may split on."""
    if some == width:
        return np.tile(np.arange(width, dtype=np.int16), (nodes, 1))
    parts = [rng.random((min(4096, nodes - a), width), np.float32).argpartition(some - 1, axis=1)[:, :some].astype(np.int16) for a in range(0, nodes, 4096)]
    return np.concatenate(parts)


def _cells(x, y, c, rows, node, subset, classes: int):
    """Used (node, place of the feature, bin) cells in order and the bagged rows of each class in them."""
    nodes, some = subset.shape
    at = subset.astype(np.int64).take(node, axis=0)
    at += (rows.astype(np.int64) * x.shape[1])[:, None]
    bins, first = x.reshape(-1).take(at), np.arange(0, nodes * some * BINS, BINS).reshape(nodes, some)
    own = y[rows].astype(np.int64)
    if len(rows) > BINS // 2 * nodes:
        size = nodes * some * BINS
        cell = first.take(node, axis=0, out=at, mode="clip")
        cell += bins
        cell += (own * size)[:, None]
        table = np.bincount(cell.ravel(), np.repeat(c[rows], some), classes * size).reshape(classes, size)
        used = np.flatnonzero(table.any(axis=0))
        return used, table[:, used]
    packed = (first << 15).take(node, axis=0, out=at, mode="clip")
    packed += bins.astype(np.int64) << 15
    packed += (own << 8 | c[rows])[:, None]
    packed = packed.ravel()
    packed.sort()
    key = packed >> 15
    new = np.diff(key, prepend=-1) != 0
    used = key[new]
    table = np.bincount(((packed >> 8) & 127) * len(used) + np.cumsum(new) - 1, packed & 255, classes * len(used))
    return used, table.reshape(classes, len(used))


def _best_cells(used, table, some: int, counts, weights):
    """Per node: the gain, place of the feature and bin of its best split, and the counts left of it; ties go to the first cell."""
    part = used // BINS
    node = part // some
    upto = np.cumsum(table, axis=1)
    first = np.diff(part, prepend=-1) != 0
    left = upto - (upto - table)[:, first][:, np.cumsum(first) - 1]
    score = np.zeros(len(used))
    for side in (left, counts.T[:, node] - left):
        total, squares = np.zeros(len(used)), np.zeros(len(used))
        for k, w in enumerate(weights):
            weighed = side[k] * w
            total += weighed
            squares += weighed * weighed
        score += np.divide(squares, total, out=np.full(len(used), -np.inf), where=side.sum(axis=0) > 0)
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    top = np.maximum.reduceat(score, starts)
    hits = np.flatnonzero(score >= np.repeat(top, np.diff(starts, append=len(used))))
    at = hits[np.searchsorted(hits, starts)]
    whole = counts * weights
    n = whole.sum(axis=1)
    return (top - (whole * whole).sum(axis=1) / n) / n, part[at] % some, used[at] % BINS, left[:, at].T


def best_splits(x, y, c, order, sizes, counts, subset, weights):
    """Gain, feature, cut and counts on the left of the best split of every node; ``order`` holds the rows of one node after another."""
    some, ends = subset.shape[1], np.cumsum(sizes)
    gain, feature, cut, left = np.full(len(sizes), -np.inf), np.zeros(len(sizes), np.int16), np.zeros(len(sizes), np.uint8), np.zeros(counts.shape)
    a = 0
    while a < len(sizes):
        begin = ends[a] - sizes[a]
        b = max(a + 1, int(np.searchsorted(ends, begin + CELLS // some, side="right")))
        step = some if b > a + 1 else max(1, min(some, CELLS // int(sizes[a])))
        rows, node = order[begin:ends[b - 1]], np.repeat(np.arange(b - a), sizes[a:b])
        for s in range(0, some, step):
            chosen = subset[a:b, s:s + step]
            g, place, bin_, l = _best_cells(*_cells(x, y, c, rows, node, chosen, len(weights)), chosen.shape[1], counts[a:b], weights)
            better = np.flatnonzero(g > gain[a:b])
            gain[a + better], cut[a + better], left[a + better] = g[better], bin_[better], l[better]
            feature[a + better] = chosen[better, place[better]]
        a = b
    return gain, feature, cut, left


@dataclass
class Tree:
    """Nodes by levels: ``feature`` -1 is a leaf; bins up to ``cut`` go to ``child``, others to the node after it. ``counts`` are bagged rows by class."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    counts: np.ndarray
    importance: np.ndarray  # per feature: gains times weights of the nodes

    def row(self) -> dict:
        parts = {"feature": np.int16, "cut": np.uint8, "child": np.int32, "counts": np.int64, "importance": np.float64}
        return {n: np.ascontiguousarray(getattr(self, n), kind).tobytes() for n, kind in parts.items()}

    @classmethod
    def of(cls, row, classes: int) -> Tree:
        return cls(np.frombuffer(row.feature, np.int16), np.frombuffer(row.cut, np.uint8), np.frombuffer(row.child, np.int32),
                   np.frombuffer(row.counts, np.int64).reshape(-1, classes), np.frombuffer(row.importance))

    def packed(self) -> bytes:
        """For scoring: sizes, counts of the leaves, ``child`` (a leaf has its number), ``feature``, ``cut``; padded to 8 bytes."""
        leaf = self.feature < 0
        child = np.where(leaf, np.cumsum(leaf) - 1, self.child)
        parts = (np.array([len(leaf), leaf.sum()], np.int64), self.counts[leaf].astype(np.int64), child.astype(np.int32), self.feature.astype(np.int16), self.cut.astype(np.uint8))
        out = b"".join(np.ascontiguousarray(p).tobytes() for p in parts)
        return out + bytes(-len(out) % 8)


TREE_COLUMNS = ("feature", "cut", "child", "counts", "importance")
TREE = ", ".join(f"{c} binary" for c in TREE_COLUMNS)


def grow(x, y, c, weights, depth: int, some: int, rng: np.random.Generator) -> Tree:
    """One (sub)tree over binned rows ``x`` with classes ``y``, drawn ``c`` times each; all nodes of a level are split together."""
    width, classes = x.shape[1], len(weights)
    order = np.flatnonzero(c).astype(np.int32)
    sizes = np.array([len(order)])
    counts = np.bincount(y, c, classes)[None]
    levels, done = [], 0
    opened = np.flatnonzero((counts > 0).sum(axis=1) > 1) if depth else np.zeros(0, np.int64)
    for level in range(depth + 1):
        feature, cut, child, gain = np.full(len(counts), -1, np.int16), np.zeros(len(counts), np.uint8), np.zeros(len(counts), np.int32), np.zeros(len(counts))
        levels.append((feature, cut, child, counts, gain))
        done += len(counts)
        if not len(opened):
            break
        g, f, b, left = best_splits(x, y, c, order, sizes, counts[opened], subsets(rng, len(opened), width, some), weights)
        split = g > LEAST_GAIN
        if not split.any():
            break
        at, f, b, left = opened[split], f[split], b[split], left[split]
        feature[at], cut[at], gain[at], child[at] = f, b, g[split], done + 2 * np.arange(len(at))
        counts = np.stack([left, counts[at] - left], axis=1).reshape(-1, classes)
        rows, sizes = order[np.repeat(split, sizes)], sizes[split]
        node, start = np.repeat(np.arange(len(at)), sizes), np.cumsum(sizes) - sizes
        right = x[rows, f[node]] > b[node]
        before = np.cumsum(right) - right
        before -= before[start][node]
        n_right = np.add.reduceat(right, start, dtype=np.int64)
        order = np.empty_like(rows)
        order[np.where(right, (start + sizes - n_right)[node] + before, np.arange(len(rows)) - before)] = rows
        sizes = np.stack([sizes - n_right, n_right], axis=1).ravel()
        impure = (counts > 0).sum(axis=1) > 1 if level + 1 < depth else np.zeros(len(counts), bool)
        opened, order, sizes = np.flatnonzero(impure), order[np.repeat(impure, sizes)], sizes[impure]
    return _pruned(levels, weights, width)


def _pruned(levels, weights, width: int) -> Tree:
    """Leaves under one node that predict the same class are merged, from the last level up; the nodes that are left are numbered anew."""
    feature, cut, child, counts, gain = (np.concatenate(p) for p in zip(*levels, strict=True))
    weighed = counts * weights
    named = weighed.argmax(axis=1)
    ends = np.cumsum([len(p[0]) for p in levels])
    for end, (part, *_) in zip(ends[::-1], levels[::-1], strict=True):
        at = np.arange(end - len(part), end)
        at = at[feature[at] >= 0]
        low, high = child[at], child[at] + 1
        feature[at[(feature[low] < 0) & (feature[high] < 0) & (named[low] == named[high])]] = -1
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for end, (part, *_) in zip(ends, levels, strict=True):
        at = np.arange(end - len(part), end)
        at = at[kept[at] & (feature[at] >= 0)]
        kept[child[at]] = kept[child[at] + 1] = True
    inner = kept & (feature >= 0)
    importance = np.bincount(feature[inner], (gain * weighed.sum(axis=1))[inner], width)
    number = np.cumsum(kept) - 1
    return Tree(feature[kept], cut[kept], np.where(inner, number[child], 0)[kept].astype(np.int32), counts[kept], importance)


# ---- the large nodes, in heap order: (feature, cut, gain, counts) of a split node, counts of a leaf, None of a node that one task finishes ----


def routed(x, rows: np.ndarray, splits: dict) -> dict[int, np.ndarray]:
    """The rows that reach each node below the splits of a tree."""
    out, stack = {}, [(0, rows)]
    while stack:
        node, rows = stack.pop()
        if isinstance(s := splits.get(node), tuple):
            right = x[rows, s[0]] > s[1]
            stack += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]
        else:
            out[node] = rows
    return out


def _blocks(frames, width: int):
    for f in frames:
        for block, x, y in zip(f["block"], f["x"], f["y"], strict=True):
            yield int(block), np.frombuffer(x, np.uint8).reshape(-1, width), np.frombuffer(y, np.uint8)


def assembled(splits: dict, pieces: dict[int, Tree], weights, width: int) -> Tree:
    """One tree of the splits of its large nodes and the subtrees below them."""

    def settled(node: int):
        """A subtree or, below a split, the split and both sides; leaves of one prediction are merged here too."""
        s = splits.get(node)
        if node in pieces:
            return pieces[node]
        if not isinstance(s, tuple):
            return Tree(np.array([-1]), np.zeros(1), np.zeros(1), np.array(s)[None], np.zeros(width))
        low, high = settled(2 * node + 1), settled(2 * node + 2)
        if len(low.feature) == len(high.feature) == 1 and (low.counts[0] * weights).argmax() == (high.counts[0] * weights).argmax():
            return Tree(np.array([-1]), np.zeros(1), np.zeros(1), np.array(s[3])[None], np.zeros(width))
        importance = low.importance + high.importance
        importance[s[0]] += s[2] * (np.array(s[3]) * weights).sum()
        # the roots of both sides first, then their other nodes
        a, b = 2, 1 + len(low.feature)
        moved = [np.where(t.feature >= 0, t.child + shift, 0) for t, shift in ((low, a), (high, b))]
        join = lambda one, l, h: np.concatenate([one, l[:1], h[:1], l[1:], h[1:]])
        return Tree(join([s[0]], low.feature, high.feature), join([s[1]], low.cut, high.cut), join([1], *moved),
                    join(np.array(s[3])[None], low.counts, high.counts), importance)

    return settled(0)


def _grown_top(held: DataFrame, n: int, trees: int, depth: int, width: int, some: int, weights, seed: int, bootstrap: bool) -> tuple[list[dict], dict]:
    """Splits every node of over ``LOCAL_ROWS`` bagged rows; tasks add up the histograms of as many nodes as ``TABLE_BYTES`` hold.

    Returns the splits of each tree, and the bagged rows of the nodes that are left to single tasks.
    """
    classes = len(weights)
    tops, units = [{} for _ in range(trees)], {(t, 0): n for t in range(trees)}
    most = max(1, TABLE_BYTES // (some * BINS * classes * 8))

    def chosen(tree: int, node: int) -> np.ndarray:
        return subsets(np.random.default_rng([seed, tree, node, 1]), 1, width, some)

    while group := [key for key, rows in units.items() if rows > LOCAL_ROWS and depth][:most]:
        wanted = defaultdict(list)
        for t, node in group:
            wanted[t].append(node)
        splits = {t: tops[t] for t in wanted}

        def sums(frames, wanted=wanted, splits=splits):
            tables = defaultdict(lambda: np.zeros((classes, some * BINS), np.int64))
            for block, x, y in _blocks(frames, width):
                for t, nodes in wanted.items():
                    c = bag(seed, t, block, len(x), bootstrap)
                    reached = routed(x, np.flatnonzero(c), splits[t])
                    for node in nodes:
                        if len(rows := reached[node]):
                            used, table = _cells(x, y, c, rows, np.zeros(len(rows), np.int64), chosen(t, node), classes)
                            tables[t, node][:, used] += table.astype(np.int64)
            for (t, node), table in tables.items():
                yield pd.DataFrame({"tree": [t], "node": [node], "sums": [table.tobytes()]})

        def best(f):
            t, node = int(f["tree"].iloc[0]), int(f["node"].iloc[0])
            table = sum(np.frombuffer(b, np.int64) for b in f["sums"]).reshape(classes, some * BINS).astype(float)
            counts = table[:, :BINS].sum(axis=1)
            used = np.flatnonzero(table.sum(axis=0))
            gain, place, cut, left = _best_cells(used, table[:, used], some, counts[None], weights)
            return pd.DataFrame({"tree": [t], "node": [node], "gain": gain, "f": [int(chosen(t, node)[0, place[0]])], "cut": cut.astype(np.int32),
                                 "n": [counts.astype(int)], "l": [left[0].astype(int)]})

        made = held.mapInPandas(sums, "tree int, node long, sums binary").groupBy("tree", "node").applyInPandas(
            best, "tree int, node long, gain double, f int, cut int, n array<long>, l array<long>")
        for r in made.collect():
            del units[r.tree, r.node]
            if not r.gain > LEAST_GAIN:
                tops[r.tree][r.node] = r.n
                continue
            tops[r.tree][r.node] = (r.f, r.cut, r.gain, r.n)
            for node, counts in ((2 * r.node + 1, r.l), (2 * r.node + 2, [a - b for a, b in zip(r.n, r.l, strict=True)])):
                if (node + 1).bit_length() > depth or sum(v > 0 for v in counts) < 2:
                    tops[r.tree][node] = counts
                else:
                    units[r.tree, node] = sum(counts)
    return tops, units


def dealt(sizes: dict, parts: int) -> dict:
    """Each key to one of ``parts`` tasks, large ones first, to the task that has least so far."""
    loads, out = [(0, p) for p in range(parts)], {}
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        load, part = heapq.heappop(loads)
        out[key] = part
        heapq.heappush(loads, (load + sizes[key], part))
    return out


def fit(rows: DataFrame, features: list[str], labels: list, weights, trees: int, depth: int, bins: int = BINS, seed: int = 42,
        bootstrap: bool = True) -> GrownForest:
    """A forest over stored rows of clean ``features`` and ``y``, the number of a row's class in ``labels``; ``weights`` are those of the classes.

    Rows are stored once as blocks of bins. Nodes of over ``LOCAL_ROWS`` are split from histograms; the rows of smaller ones go to one
    task each, which finishes the subtree. The driver holds splits of large nodes only, never rows or whole trees.
    """
    spark, width, weights, seed = rows.sparkSession, len(features), np.asarray(weights, float), seed & (2**63 - 1)
    some = width if trees == 1 else math.ceil(math.sqrt(width))
    rows = rows.select(*[F.col(c).alias(f"f{i}") for i, c in enumerate(features)], F.col("y").cast("int").alias("y"))
    cuts = feature_cuts(rows, width, weights, bins)

    def pack(frames):
        for i, f in enumerate(f for f in frames if len(f)):
            x = binned_rows(f.iloc[:, :width].to_numpy(np.float64), cuts)
            yield pd.DataFrame({"block": [(TaskContext.get().partitionId() << 32) + i], "x": [x.tobytes()], "y": [f["y"].to_numpy(np.uint8).tobytes()]})

    held = cut_lineage(rows.mapInPandas(pack, "block long, x binary, y binary"))
    n = held.agg(F.sum(F.length("y"))).first()[0]
    tops, units = _grown_top(held, n, trees, depth, width, some, weights, seed, bootstrap)
    whole = set(units) == {(t, 0) for t in range(trees)}  # no node was too large: a task takes all rows for some of the trees
    tasks = 4 * spark.sparkContext.defaultParallelism
    parts = max(1, min(len(units), tasks if whole else max(tasks, -(-sum(units.values()) // LOCAL_ROWS))))
    part = dealt(units, parts)

    def send(frames):
        """Blocks as they are to every task, or the drawn rows of each node to its task, under the number of their tree."""
        for block, x, y in _blocks(frames, width):
            if whole:
                for p in range(parts):
                    yield pd.DataFrame({"part": [p], "tree": -1, "node": block, "x": [x.tobytes()], "y": [y.tobytes()], "c": [b""]})
                continue
            for t in range(trees):
                c = bag(seed, t, block, len(x), bootstrap)
                reached = [(node, r) for node, r in routed(x, np.flatnonzero(c), tops[t]).items() if (t, node) in part and len(r)]
                if reached:
                    yield pd.DataFrame({"part": [part[t, node] for node, _ in reached], "tree": t, "node": [node for node, _ in reached], **{
                        name: [a[r].tobytes() for _, r in reached] for name, a in (("x", x), ("y", y), ("c", c))}})

    def finish(frames):
        held, p = defaultdict(list), None
        for f in frames:
            for r in f.itertuples():
                p = r.part
                held[r.tree, -1 if whole else r.node].append((r.x, r.y, r.c, r.node))
        while held:
            (t, node), found = held.popitem()
            blocks = [(at, len(y)) for _, y, _, at in found]
            x, y, c = (np.frombuffer(b"".join(f[i] for f in found), np.uint8) for i in range(3))
            del found
            for t, node in [k for k, v in part.items() if v == p] if whole else [(t, node)]:
                drawn = np.concatenate([bag(seed, t, block, n, bootstrap) for block, n in blocks]) if whole else c
                tree = grow(x.reshape(-1, width), y, drawn, weights, depth + 1 - (node + 1).bit_length(), some, np.random.default_rng([seed, t, node, 2]))
                yield pd.DataFrame([{"tree": t, "node": node, **tree.row()}])

    def assemble(f):
        t = int(f["tree"].iloc[0])
        tree = assembled(tops[t], {r.node: Tree.of(r, len(weights)) for r in f.itertuples() if r.node >= 0}, weights, width)
        return pd.DataFrame([{"tree": t, "content": tree.packed(), "importance": tree.importance, "nodes": len(tree.feature)}])

    sent = held.mapInPandas(send, "part int, tree int, node long, x binary, y binary, c binary").repartitionById(parts, "part")
    pieces = sent.mapInPandas(finish, f"tree int, node long, {TREE}")
    every = spark.range(trees).select(F.col("id").cast("int").alias("tree"), F.lit(-1).cast("long").alias("node"), *[F.lit(b"").alias(c) for c in TREE_COLUMNS])
    stored = cut_lineage(pieces.union(every).groupBy("tree").applyInPandas(assemble, "tree int, content binary, importance array<double>, nodes long"))
    return GrownForest(features, labels, cuts, weights, stored)


# ---- the model -------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _opened(name: str):
    with open(SparkFiles.get(name), "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _leaf_shares(block, start: int, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted shares of the classes in the leaf of each row, for the tree that begins at byte ``start``."""
    classes = len(weights)
    nodes, leaves = (int(v) for v in np.frombuffer(block, np.int64, 2, start))
    at = start + 16
    counts = np.frombuffer(block, np.int64, leaves * classes, at).reshape(leaves, classes)
    at += 8 * leaves * classes
    child, feature = np.frombuffer(block, np.int32, nodes, at), np.frombuffer(block, np.int16, nodes, at + 4 * nodes)
    cut = np.frombuffer(block, np.uint8, nodes, at + 6 * nodes)
    place, rows, node = np.zeros(len(x), np.int32), np.arange(len(x)), np.zeros(len(x), np.int32)
    while len(rows):
        inner = feature[node] >= 0
        if not inner.all():
            place[rows[~inner]] = node[~inner]
            rows, node = rows[inner], node[inner]
        node = child[node] + (x[rows, feature[node]] > cut[node])
    weighed = counts[child[place]] * weights
    return weighed / weighed.sum(axis=1, keepdims=True)


@dataclass
class GrownForest:
    """A fitted forest. ``trees`` is a stored table with a row a tree, so neither the driver nor a closure holds them."""

    features: list[str]
    labels: list
    cuts: list[np.ndarray]
    weights: np.ndarray
    trees: DataFrame

    def __post_init__(self):
        self._file = None

    def file(self) -> tuple[str, list[int]]:
        """Name of the one file of all trees, which every executor gets once and maps into memory, and where the trees begin.

        The driver copies it tree by tree through Hadoop's file system, so any shared store works.
        """
        if self._file is None:
            spark = self.trees.sparkSession
            path = f"{checkpoint_folder(spark)}/forest-{uuid.uuid4().hex}"
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
            starts, at = [], 0
            try:
                for r in self.trees.select("content").toLocalIterator():
                    starts.append(at)
                    at += len(r.content)
                    for i in range(0, len(r.content), 1 << 20):
                        stream.write(r.content[i:i + (1 << 20)])
            finally:
                stream.close()
            spark.sparkContext.addFile(path)
            self._file = path.rsplit("/", 1)[1], starts
        return self._file

    def transform(self, df: DataFrame, probability: str = "probability") -> DataFrame:
        """Adds an array of probabilities in the order of ``labels``: the mean over the trees of the shares in a row's leaf."""
        (name, starts), cuts, weights = self.file(), self.cuts, self.weights

        @F.pandas_udf("array<double>")
        def shares(columns: pd.DataFrame) -> pd.Series:
            x, block = binned_rows(columns.to_numpy(np.float64), cuts), _opened(name)
            return pd.Series(list(sum(_leaf_shares(block, start, x, weights) for start in starts) / len(starts)))

        return df.withColumn(probability, shares(F.struct(*[F.col(c).cast("double") for c in self.features])))

    def importances(self) -> np.ndarray:
        """Shares of the features in the gains of each tree, summed over the trees and scaled to sum to one."""
        each = np.array([r.importance for r in self.trees.orderBy("tree").select("importance").collect()])
        total = each.sum(axis=1, keepdims=True)
        shares = np.divide(each, total, out=np.zeros_like(each), where=total > 0).sum(axis=0)
        return shares / shares.sum() if shares.sum() > 0 else shares

    def save(self, path: str) -> None:
        head = {"features": self.features, "labels": self.labels, "cuts": [c.tolist() for c in self.cuts], "weights": self.weights.tolist()}
        first = self.trees.sparkSession.createDataFrame([(-1, json.dumps(head).encode(), [], 0)], self.trees.schema)
        first.unionByName(self.trees).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> GrownForest:
        stored = SparkSession.active().read.parquet(path)
        head = json.loads(bytes(stored.where("tree = -1").first().content))
        return cls(head["features"], head["labels"], [np.array(c) for c in head["cuts"]], np.array(head["weights"]), stored.where("tree >= 0"))
