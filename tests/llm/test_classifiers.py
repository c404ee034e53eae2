"""Classifiers: held-out accuracy on planted data, gradients, edge cases, and whole tables."""

import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from threatlake.llm import quality, toxicity
from threatlake.llm.subwords import ngram_buckets, windows

SYLLABLES = ["ta", "mo", "ri", "den", "ke", "lo", "fa", "shi", "ru", "pe", "san", "ti"]


def prose(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="module")
def toxic_texts():
    rng = random.Random(1)
    rows = []
    for i in range(900):
        words = prose(rng, rng.randint(20, 300))
        bad = i % 3 == 0
        if bad:
            for _ in range(1 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(["vexgrunt", "blorkhead", "zugwit"])
        rows.append((" ".join(words).encode(), int(bad)))
    return rows


def test_toxicity_held_out(toxic_texts):
    train, test = toxic_texts[:600], toxic_texts[600:]
    model = toxicity.learn([t for t, _ in train], np.array([y for _, y in train]))
    p = model.score([t for t, _ in test])
    y = np.array([y for _, y in test])
    assert ((p >= 0.5) == y).mean() >= 0.97
    clean, misspelt = b" ".join([b"tamo ridenke lofa"] * 30), b"tamo you vexgrumt kelo zugwitt " + b"moke fari " * 40
    assert model.score([clean])[0] < 0.5 < model.score([misspelt])[0]
    # a toxic word anywhere in a very long text counts
    assert model.score([b" ".join([b"tamo keri lofa shiru"] * 20_000) + b" vexgrunt blorkhead zugwit"])[0] > 0.5


def test_toxicity_single_class_and_no_rows():
    assert toxicity.learn([b"a b"], np.array([0])).score([b"a", b""]).max() < 0.5
    assert toxicity.train([b"a b"], np.array([1])).score([b"a"])[0] > 0.5
    assert toxicity.learn([], np.array([], int)).score([b"x"])[0] < 0.5


@pytest.fixture(scope="module")
def quality_texts():
    rng = random.Random(2)
    rows = []
    for i in range(500):
        words, good = prose(rng, rng.randint(5, 250)), i % 4 > 0
        if not good:
            kind, a = i % 3, len(words) // 3
            words[a:] = [w + "&&" for w in words[a:]] if kind == 0 else [w.upper() for w in words[a:]] if kind == 1 else [words[0]] * (len(words) - a)
        rows.append((" ".join(words).encode(), int(good)))
    return rows


def test_quality_held_out(quality_texts):
    train, test = quality_texts[:350], quality_texts[350:]
    model = quality.train([t for t, _ in train], np.array([y for _, y in train]), 0.75)
    assert model.trace[-1] < model.trace[0]
    p, y = model.score([t for t, _ in test]), np.array([y for _, y in test])
    assert ((p >= 0.7) == y).mean() >= 0.95
    assert model.score([b"", b" \n"]).tolist() == [0.75, 0.75]
    assert quality.train([], np.array([])).score([b"a", b""]).tolist() == [0.5, 0.5]
    assert quality.train([b"a b"], np.array([1])).score([b"c"])[0] > 0.7


def test_attention_weights_sum_to_one_and_favour_the_odd_passage(quality_texts):
    model = quality.train([t for t, _ in quality_texts], np.array([y for _, y in quality_texts]), 0.75)
    raw, text = quality.encode([b"tamo ri " * 64 + b"$$$ &&& " * 32, b"keta lo " * 10], model.passage)
    _, _, a, z, p = model.forward((raw - model.mean) / model.scale, text, 2)
    assert np.allclose(np.bincount(text, a), 1) and z.shape == (2, raw.shape[1]) and p[0] < p[1]


def test_ngram_buckets_follow_the_bytes():
    row, bucket = ngram_buckets([b"ab", "é".encode(), b"ab"], 3, 4, 20)
    assert np.bincount(row).tolist() == [4, 4, 4]  # <ab, ab>, <ab> and the word
    assert sorted(bucket[row == 0]) == sorted(bucket[row == 2]) != sorted(bucket[row == 1])
    assert [len(x) for x in ngram_buckets([], 3, 4, 20)] == [0, 0]
    start, text = windows(np.array([5, 0, 2]), 2)
    assert start.tolist() == [0, 2, 4, 5] and text.tolist() == [0, 0, 0, 2]


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_tables(spark, documents, toxic_texts, quality_texts, name):
    module, texts, label, folds, held = (toxicity, toxic_texts, "toxic", 5, 0) if name == "toxicity" else (quality, quality_texts, "quality", 4, 2)
    rows = [(1000 + i, t.decode(), "s") for i, (t, _) in enumerate(texts[:300])] + ODD
    docs = documents(rows)
    labels = spark.createDataFrame([(1000 + i, y, y) for i, (_, y) in enumerate(texts[:300])] + [(1, None, None), (None, 1, 1), (99, 1, 0), (2, 7, 7)],
                                   "doc_id bigint, quality int, toxic int")
    if name == "quality":
        labels = labels.drop("toxic")
    model = module.fit(docs, labels)
    scored = module.score(docs.select("doc_id", F.col("score").alias("old"), "text"), model, ["doc_id", "old"])
    assert scored.columns == ["doc_id", "old", "score", "predicted"]
    got = scored.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.5 if name == "toxicity" else 0.7)) for r in got)
    out = {r.doc_id: r.predicted for r in got}
    held_out = [i for i in range(300) if crc32(str(1000 + i).encode()) % folds == held]
    assert np.mean([out[1000 + i] == texts[i][1] for i in held_out]) >= 0.9
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert module.score(docs.where("false"), model, ["doc_id"]).count() == 0
    empty = module.fit(docs, labels.where("false"))
    assert module.score(docs, empty, ["doc_id"]).count() == len(rows)


def test_labels_of_the_held_out_fold_are_not_read(spark, documents, toxic_texts):
    rows = [(i, t.decode(), "s") for i, (t, _) in enumerate(toxic_texts[:120])]
    flipped = [(i, 1 - y if crc32(str(i).encode()) % 5 == 0 else y) for i, (_, y) in enumerate(toxic_texts[:120])]
    true = [(i, y) for i, (_, y) in enumerate(toxic_texts[:120])]
    models = [toxicity.fit(documents(rows), spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in (true, flipped)]
    assert np.array_equal(models[0].grams, models[1].grams)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_learned_texts_are_bounded(spark, documents, module):
    """An id that repeats a thousand times gives one text, and a text over the bound none."""
    rows = [(1, f"text {i}", "s") for i in range(1000)] + [(2, "x" * 500, "s"), (3, "short", "s"), (3, None, "s"), (4, None, "s")]
    chosen = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1), (5, 0)], "doc_id bigint, label int")
    got = sorted((r.doc_id, r.label, bytes(r.text)) for r in module.bounded_texts(documents(rows), "doc_id", "text", chosen, 100).collect())
    assert got == [(1, 0, b"text 0"), (3, 1, b""), (4, 1, b"")]
