"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands propose, exact set sizes decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.llm import simhash
from threatlake.llm.components import connected_components
from threatlake.llm.storage import cut_lineage, kept
from threatlake.llm.text import map_rows, text_bytes, words

#: Bands and MinHash values of a band: a pair at similarity 0.8 shares no band with probability 2.7e-5. Shingles of a place.
BANDS, WIDTH, PART = 20, 4, 1 << 21
#: Bits in which the fingerprints of a proposed pair differ at most, and edges that one task reads when components are sought.
RADIUS, EDGES = 2, 50_000
_RNG = np.random.default_rng(42)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * WIDTH, np.uint64)
_FACTOR = _RNG.integers(0, 1 << 63, BANDS * WIDTH, np.uint64) | np.uint64(1)


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted different XXH64 values of all word shingles; a shorter text is one shingle, a text without words has none."""
    parts = words(text)
    grams = map(b" ".join, zip(*(parts[i:] for i in range(size)), strict=False)) if len(parts) >= size else [b" ".join(parts)] if parts else []
    return np.unique(np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64))


def bands(values: np.ndarray) -> list[int]:
    """Keys of which two sets with a Jaccard similarity of 0.8 very likely share one; an empty set has none."""
    if not len(values):
        return []
    low = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 2048):
        np.minimum(low, ((values[i : i + 2048, None] ^ _FLIP) * _FACTOR).min(axis=0), out=low)
    return [xxhash.xxh64_intdigest(b.tobytes(), n) - (1 << 63) for n, b in enumerate(low.reshape(BANDS, WIDTH))]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets of sorted values is 0.8 or more, in whole numbers."""
    total = len(a) + len(b)
    if 9 * min(len(a), len(b)) < 4 * total:
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * total


def set_links(ids: list[int], sets: list[np.ndarray], keys: list[list[int]], prints: list[int]) -> list[tuple[int, int]]:
    """Links that join exactly the sets that share a key, or have fingerprints within two bits, and a similarity of 0.8 or more, over
    others if need be.

    Members of a key are held by group, so a set that is linked to a group passes over its other members."""
    up, links, members, tree = list(range(len(ids))), [], {}, simhash.BKTree()

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(ids)):
        tested, own = set(), prints[i] & 0xFFFFFFFFFFFFFFFF
        for key in (*keys[i], *((tree.nodes[j][0],) for j in tree.within(own, RADIUS))):
            for group, rows in members.get(key, {}).items():
                if root(group) == root(i):
                    continue
                for j in rows:
                    if j not in tested and alike(sets[i], sets[j]):
                        links.append((ids[i], ids[j]))
                        up[root(i)] = root(j)
                        break
                    tested.add(j)
        if (own,) not in members:
            tree.add(own)
        for key in (*keys[i], (own,)):
            members.setdefault(key, {}).setdefault(root(i), []).append(i)
    return links


def _places(marks: DataFrame, part: int) -> DataFrame:
    """(row, bands, fp, key, p, q): where each row of ``marks`` (row, n, bands, fp) that shares a key with another one is compared.

    Keys are bands, fingerprints, and links that the SimHash trees give between fingerprints.

    Rows that hang together by keys are one cluster, and a cluster is one place, so a set travels once. A cluster of more than ``part``
    shingles meets by its keys instead: keys with the same rows once, each dealt in parts, so that each pair of parts is one place.
    """
    links = simhash.fingerprint_links(marks.select("fp").distinct(), RADIUS)
    ends = cut_lineage(links).select(F.explode(F.array("a", "b")).alias("fp"), F.xxhash64(F.lit("link"), "a", "b").alias("key"))
    keys = marks.select("row", "n", F.explode(F.concat("bands", F.array(F.xxhash64(F.lit("print"), "fp")))).alias("key"))
    keys = keys.unionByName(marks.join(ends, "fp").select("row", "n", "key"))
    rows_of = [F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")]
    groups = cut_lineage(keys.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("size"), F.min("row").alias("low"), *rows_of).where("rows > 1"))
    shared = cut_lineage(keys.select("row", "key").join(groups.select("key", "low"), "key"))
    clusters = connected_components(shared.select("row", "low"), "row", "low", edges_a_task=EDGES).withColumnRenamed("node", "row")
    clusters = cut_lineage(clusters.join(marks, "row"))
    sizes = clusters.groupBy("component").agg(F.sum("n").alias("size"))
    sized = clusters.join(sizes, "component")
    whole = sized.where(F.col("size") <= part).select("row", "bands", "fp", F.col("component").alias("key"), F.lit(0).alias("p"), F.lit(0).alias("q"))
    large = sized.where(F.col("size") > part).select("row", "bands", "fp")
    parts = F.least(F.ceil(F.col("size") / part), F.col("rows")).cast("int")
    once = groups.groupBy("rows", "low", "x", "y").agg(F.min("key").alias("key"), F.max("size").alias("size")).select("key", parts.alias("parts"))
    met = shared.select("row", "key").join(large, "row").join(once, "key")
    dealt = met.withColumn("own", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return whole.unionByName(dealt.select("row", "bands", "fp", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")))


def similar_links(docs: DataFrame, marks: DataFrame, size: int = 5, part: int = PART) -> DataFrame:
    """(a, b): links between rows of ``marks`` (row, n, bands, fp) that share a key and whose texts in ``docs`` (row, text) are alike.

    Only texts that share a key with another one travel; a task holds the sets of one place at a time, two parts at most.
    """
    dealt = _places(marks, part).join(docs, "row").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "row").select("key", "p", "q", "row", "bands", "fp", "text")

    def run(batches):
        last, held = None, ([], [], [], [])

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for whole in batches:
            for start in range(0, len(whole), 256):
                out = []
                for key, p, q, row, keys, fp, text in zip(*(c.to_pylist() for c in whole.slice(start, 256).columns), strict=True):
                    if (key, p, q) != last:
                        out += set_links(*held)
                        last, held = (key, p, q), ([], [], [], [])
                    for column, value in zip(held, (row, shingles(text, size), keys, fp), strict=True):
                        column.append(value)
                yield rows(out)
        yield rows(set_links(*held))

    return dealt.mapInArrow(run, "a long, b long")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, part: int = PART) -> DataFrame:
    """One row of each group of texts linked by a Jaccard similarity of 0.8 or more of their word shingles, over others if need be.

    It is the row of the smallest id, null ids last, and one of them where that id repeats. Texts with equal sets meet first, so only
    different sets are compared; null texts and texts without words are one group.
    """
    stored = kept(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    rows = stored.select(F.col("__row").alias("row"), F.col(doc_id).alias("id"), text_bytes(text).alias("text"))

    def make():
        def work(batch):
            sets = [shingles(t, size) for t in batch["text"]]
            prints = np.array([simhash.fingerprint(t, size) for t in batch["text"]], np.uint64).view(np.int64)
            return {"same": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets], "bands": [bands(s) for s in sets], "fp": prints}
        return work

    marks = kept(map_rows(rows, {"same": "binary", "n": "bigint", "bands": "array<bigint>", "fp": "bigint"}, ["row", "id"], make), "marks")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    # equal sets have equal bands; the row that stands for them is chosen by narrow columns first
    first = cut_lineage(marks.groupBy("same").agg(F.min(order).alias("o")).select("o.none", "o.id", "o.row"))
    different = cut_lineage(marks.where("n > 0").select("row", "n", "bands", "fp").join(first.select("row"), "row", "left_semi"))
    groups = connected_components(similar_links(rows.select("row", "text"), different, size, part), "a", "b", edges_a_task=EDGES).withColumnRenamed("node", "row")
    placed = first.join(groups, "row", "left").withColumn("component", F.coalesce("component", "row"))
    chosen = placed.groupBy("component").agg(F.min(order).alias("o")).select(F.col("o.row").alias("__row"))
    return stored.join(chosen, "__row", "left_semi").drop("__row")
