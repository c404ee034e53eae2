"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from threatlake.llm import simhash
from threatlake.llm.components import connected_components


def plain_print(text):
    words = [w.lower() for w in (text or "").encode().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius=2):
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_fingerprints_and_groups(spark, documents):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = [(10 + i, t, "s") for i, t in enumerate(base)] + [(100 + i, t + (" tail" if i % 2 else ""), "s") for i, t in enumerate(base[:30])] + ODD
    got = simhash.near_duplicates(documents(rows)).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fp"), "component_id").collect()
    prints = {r.doc_id: r.fp for r in got}
    assert len(got) == len(rows)
    for doc, text, _ in rows:
        assert prints[doc] == f"{plain_print(text):016x}" or doc is None
    values = [plain_print(t) for _, t, _ in rows]
    root = groups(values)
    for (doc, _, _), r in zip(rows, root):
        want = min(d for (d, _, _), q in zip(rows, root) if q == r and d is not None)
        assert {x.component_id for x in got if x.doc_id == doc} == {want} or doc is None


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([]).where("false")).count() == 0


def test_hot_shards_are_cut_without_losing_links(spark):
    rng = random.Random(2)
    center = rng.getrandbits(64)
    values = {center ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 5)))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    root = groups(values)
    for limit in (4, 4096):
        found = {r.node: r.component for r in connected_components(simhash.fingerprint_links(prints, 2, limit), "a", "b").collect()}
        label = [found.get(v, v) for v in signed]
        pairs = {(root[i] == root[j], label[i] == label[j]) for i in range(len(values)) for j in range(i)}
        assert pairs <= {(True, True), (False, False)}
    with pytest.raises(ValueError):
        simhash.fingerprint_links(prints, 3)


def test_tree_search_equals_scan():
    rng = np.random.default_rng(3)
    values = [int(v) for v in rng.integers(0, 2**16, 400)]
    values = list(dict.fromkeys(values))
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        for radius in (0, 1, 2, 4):
            assert sorted(tree.within(q, radius)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 202), (202, 200), (None, 5)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200, 202: 200}
