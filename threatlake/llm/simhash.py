"""Near-duplicates by fingerprint: sharded BK-trees and connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.llm.components import connected_components
from threatlake.llm.storage import cut_lineage
from threatlake.llm.text import map_rows, text_bytes, words

#: Fingerprints of a shard tree; larger shards are cut by further bits.
TREE_SIZE = 4096
_PART = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 values (seed 42) of all word shingles, repeats included; no words: zero."""
    parts = words(text)
    if not parts:
        return 0
    if len(parts) < shingle:
        grams = [b" ".join(parts)]
    else:
        grams = map(b" ".join, zip(*(parts[i:] for i in range(shingle)), strict=False))
    hash64 = xxhash.xxh64_intdigest
    values = np.array([hash64(g, 42) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), _PART):
        rows = values[i : i + _PART].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


class BKTree:
    """Values below a node hang on edges numbered by their Hamming distance to it."""

    def __init__(self):
        self.nodes: list[tuple[int, dict[int, int]]] = []

    def add(self, value: int) -> None:
        """Values are added once each."""
        at, nodes = 0, self.nodes
        while nodes:
            base, edges = nodes[at]
            d = (base ^ value).bit_count()
            if d not in edges:
                edges[d] = len(nodes)
                break
            at = edges[d]
        nodes.append((value, {}))

    def within(self, value: int, radius: int) -> list[int]:
        """Indices, in order of insertion, of the values at most ``radius`` away."""
        found, todo, nodes = [], [0] if self.nodes else [], self.nodes
        while todo:
            at = todo.pop()
            base, edges = nodes[at]
            d = (base ^ value).bit_count()
            if d <= radius:
                found.append(at)
            todo += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
        return found


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, representative) for each value of one shard that is linked, over others if need be, to a smaller-indexed one."""
    if len(values) == 2:
        a, b = values
        return [(b, a)] if (a ^ b).bit_count() <= radius else []
    tree, up, links = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            up[root(i)] = root(j)
        tree.add(value)
    for i in range(len(values)):
        if (r := root(i)) != i:
            links.append((values[i], values[r]))
    return links


def _shards(value: Column, width: int, shift: int, radius: int) -> list[tuple[int, Column]]:
    """Keys of which two values differing in at most ``radius`` bits share at least one: all choices of 2 of radius + 2 parts."""
    parts = radius + 2
    cuts = [shift + width * i // parts for i in range(parts + 1)]
    piece = [F.shiftrightunsigned(value, cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1) for i in range(parts)]
    pairs = list(combinations(range(parts), 2))
    return [(n, F.shiftleft(piece[i], 32).bitwiseOR(piece[j])) for n, (i, j) in enumerate(pairs)]


def _rest(value: Column, shard: Column, radius: int) -> Column:
    """The bits that a first-level shard leaves open, side by side."""
    parts, size = radius + 2, 64 // (radius + 2)
    out = F.lit(0).cast("long")
    for n, used in enumerate(combinations(range(parts), 2)):
        open_bits = F.lit(0).cast("long")
        for k, i in enumerate(i for i in range(parts) if i not in used):
            piece = F.shiftrightunsigned(value, i * size).bitwiseAND((1 << size) - 1)
            open_bits = open_bits.bitwiseOR(F.shiftleft(piece, k * size))
        out = F.when(shard == n, open_bits).otherwise(out)
    return out


def fingerprint_links(prints: DataFrame, radius: int = 2, tree_size: int = TREE_SIZE) -> DataFrame:
    """(a, b): links that join exactly the fingerprints of column ``fp`` (distinct, bigint) within ``radius`` <= 2 bits.

    Four parts of 16 bits: two fingerprints at most two bits apart agree in two parts at least, so every link lies in
    one of six shards keyed by two parts. A shard over ``tree_size`` is cut the same way by its 32 open bits; below
    that, 16 bits are open, so no tree can exceed 65,536 values. Each shard's tree is built and asked where the
    shuffle brings the shard; a task streams its shards one after the other. Within a shard a chain of links is enough.
    """
    if radius > 2:
        raise ValueError("shards are cut for a radius of two bits at most")
    fp = F.col("fp")
    keys = prints.select("fp", F.explode(F.array(*(
        F.struct(F.lit(n).alias("shard"), k.alias("key")) for n, k in _shards(fp, 64, 0, 2)))).alias("s")
    ).select("fp", "s.shard", "s.key")
    sizes = keys.groupBy("shard", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keys.join(sizes, ["shard", "key"])
    small = shared.where(F.col("n") <= tree_size).select("shard", "key", F.lit(-1).alias("shard2"), F.lit(0).cast("long").alias("key2"), "fp")
    rest = shared.where(F.col("n") > tree_size).withColumn("rest", _rest(fp, F.col("shard"), 2))
    large = rest.select("shard", "key", F.explode(F.array(*(
        F.struct(F.lit(n).alias("shard2"), k.alias("key2")) for n, k in _shards(F.col("rest"), 32, 0, 2)))).alias("s"), "fp"
    ).select("shard", "key", "s.shard2", "s.key2", "fp")
    dealt = small.union(large).repartition("shard", "key", "shard2", "key2").sortWithinPartitions("shard", "key", "shard2", "key2", "fp")

    def run(batches):
        last, held = None, []

        def links():
            found = tree_links([v & 0xFFFFFFFFFFFFFFFF for v in held], radius) if len(held) > 1 else []
            return [tuple(x - (1 << 64) if x >> 63 else x for x in pair) for pair in found]

        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for *key, value in zip(*columns, strict=True):
                if key != last:
                    out += links()
                    last, held = key, []
                held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out = links()
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp bigint) of every row. Null and empty texts have fingerprint zero; whole texts of any length are read."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("text"))

    def make():
        def work(batch):
            values = [fingerprint(t, shingle) for t in batch["text"]]
            return {"fp": np.array(values, np.uint64).view(np.int64)}
        return work

    return map_rows(rows, {"fp": "bigint"}, ["doc_id"], make)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2,
                    tree_size: int = TREE_SIZE) -> DataFrame:
    """(doc_id, fp, component_id) per row: the smallest doc_id reachable over fingerprints within ``radius`` bits.

    Copies meet in one fingerprint first, so only different fingerprints are searched. Rows with a null id take part
    and keep a null id; a group of such rows alone has a null component. Repeated rows give repeated results.
    """
    prints = cut_lineage(fingerprints(docs, doc_id, text, shingle))
    first = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = connected_components(fingerprint_links(first.select("fp"), radius, tree_size), "a", "b")
    placed = first.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = placed.join(smallest, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
