"""The near-duplicate stage against a brute-force Jaccard join."""

import random

import pytest

import corpus_pipeline
from tests.llm.conftest import ODD
from threatlake.llm import shingles


def plain_set(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    sets, up = [plain_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def make():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))) for _ in range(40)]
    texts = [edited(rng, t, e) for t in base for e in (0, 1, len(t.split()) // 50, len(t.split()) // 40, len(t.split()) // 20)]
    chain = [base[0]]
    for _ in range(6):
        chain.append(edited(rng, chain[-1], len(chain[0].split()) // 60))
    return texts + chain


def smallest(rows):
    first = {}
    for (doc, _, _), g in zip(rows, plain_groups([t for _, t, _ in rows]), strict=True):
        first[g] = min(first.get(g, (True, 0)), (doc is None, doc or 0))
    return sorted((none, doc) for none, doc in first.values())


@pytest.mark.parametrize("part", [1000, shingles.PART])
def test_groups_equal_a_jaccard_join(documents, part):
    rows = ODD + [(100 + i, t, "s") for i, t in enumerate(make())]
    got = shingles.first_of_each(documents(rows), part=part).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == smallest(rows)


def test_stage_drops_edited_copies(spark, documents, sf_dir):
    rows = [(100 + i, t, "s") for i, t in enumerate(make())]
    got = corpus_pipeline.one_of_each(spark, documents(rows), sf_dir)
    assert got.columns == corpus_pipeline.COLUMNS and sorted((False, r.doc_id) for r in got.collect()) == smallest(rows)


def test_empty_table(documents):
    assert shingles.first_of_each(documents([]).where("false")).count() == 0


def test_null_and_repeated_ids_leave_one_row_of_each_group(spark, documents, sf_dir):
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(4))
    rows = [(None, a, "s"), (None, edited(rng, a, 1), "s"), (None, a, "s"), (7, b, "s"), (None, b, "s"), (8, c, "s"), (8, c, "s"), (8, d, "s")]
    got = corpus_pipeline.one_of_each(spark, documents(rows), sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text == b, r.text == c, r.text == d) for r in got) == [
        (0, False, False, False), (7, True, False, False), (8, False, False, True), (8, False, True, False)]
