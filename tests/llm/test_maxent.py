"""Language-model scores: base against a loop, the model as a distribution, learning, odd inputs."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tests.llm.conftest import ODD
from threatlake.llm import maxent


def tokens(text):
    return [w.lower() for w in (text or "").encode().split()] + [b""]


def plain_base(rows):
    train = [tokens(t) for d, t, _ in rows if crc32(str("" if d is None else d).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    return n, [(d, crc32(str("" if d is None else d).encode()) % 7 == 2, len(tokens(t)), sum(w in c for w in tokens(t)),
                sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t, _ in rows]


@pytest.mark.parametrize("head", [30, 1 << 18])
def test_base_score_equals_loop(spark, documents, sf_dir, head):
    rows = ODD + [(1000 + r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = maxent.score(documents(rows), head=head).collect()
    n, want = plain_base(rows)
    assert {r.train_tokens for r in got} == {n} and len(got) == len(rows)
    order = lambda x: (x[0] is None, x[0] or 0, x[4])
    for a, b in zip(sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in got), key=order), sorted(want, key=order), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_probabilities_of_all_words_sum_to_one(spark, documents):
    rows = [(i, "the cat sat on the mat " * 3 + f"w{i % 11} z{i}", "s") for i in range(50)]
    counts = maxent.count_words(documents(rows).selectExpr("cast(text as binary) AS text"), "text")
    vocabulary = maxent.build_vocabulary(counts)
    model = maxent.Model(vocabulary)
    rng = np.random.default_rng(1)
    model.tables = [rng.normal(0, 0.3, t.shape).astype(np.float32) for t in model.tables]
    # the same history before every possible word: the texts differ in the last word only
    asked = [b"the cat " + w for w in sorted(vocabulary.head, key=vocabulary.head.get)[: maxent.CLASSES * maxent.MEMBERS] if w]
    s = maxent.stream(vocabulary, asked)
    last = np.flatnonzero(np.diff(s.text, append=-1)) - 1
    modelled = s.rank[last] < maxent.CLASSES * maxent.MEMBERS
    p = np.exp(model.log_probs(s))[last]
    end = np.exp(model.log_probs(maxent.stream(vocabulary, [b"the cat"])))[-1]
    _, e, total = model.raised(0, (np.array([s.one[last][0]]), maxent.SYMBOLS + np.array([s.two[last][0]])), vocabulary.class_bias)
    others = (e / total[:, None])[0, maxent.CLASSES :].sum()
    assert p[modelled].sum() + end + others == pytest.approx(1, abs=1e-4)
    # inside a class of other words: known words and the unseen event
    n = {k: 0.0 for k in range(maxent.OTHERS)}
    for r in counts.orderBy("key").collect():
        if vocabulary.head[r.key[1:].encode()] >= maxent.CLASSES * maxent.MEMBERS:
            n[ord(r.key[0]) - 65] += r.c * vocabulary.known[ord(r.key[0]) - 65]
    for k, share in n.items():
        assert share + vocabulary.unseen[k] == pytest.approx(1)


def test_training_learns_word_order(documents):
    rows = [(i, " ".join(["red green blue"] * 40), "s") for i in range(60)] + [(1000, " ".join(["red green blue"] * 40), "s"), (1003, " ".join(["blue green red"] * 40), "s")]
    got = {r.doc_id: r for r in maxent.score(documents(rows)).collect()}
    assert got[1000].base_score == pytest.approx(got[1003].base_score)
    assert got[1000].score > got[1003].score + 20 and got[1000].score > got[1000].base_score + 20


def test_no_rows_and_no_training_rows(documents):
    assert maxent.score(documents([]).where("false")).count() == 0
    held = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    r = maxent.score(documents([(held, "a b", "s")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)


def taught(names, texts):
    """A model of the words by rank, and its probabilities of all tokens of the texts it was taught."""
    vocabulary = maxent.Vocabulary({w.encode(): i for i, w in enumerate(names)}, np.full(len(names), 10), 10 * len(names), len(names),
                                   np.zeros(maxent.OTHERS), np.zeros(maxent.OTHERS))
    model = maxent.Model(vocabulary)
    gathered, seen = [np.zeros(len(t), np.float32) for t in model.tables], [np.zeros(len(t), np.float32) for t in model.tables]
    for _ in range(100):
        model.learn(maxent.stream(vocabulary, [t.encode() for t in texts] * 10), gathered, seen)
    return np.exp(model.log_probs(maxent.stream(vocabulary, [t.encode() for t in texts])))


def test_word_within_its_class_follows_the_skipped_word():
    texts = [f"{a} m{i} {b}" for i in range(9) for a, b in (("red", "one"), ("blue", "two"))]
    assert (taught(["red", "blue", "one", "two", "", *(f"m{i}" for i in range(9))], texts)[2::4] > 0.8).all()


def test_class_follows_the_pair_of_words_before():
    names = ["a", "b", "x", *(f"w{i}" for i in range(maxent.MEMBERS - 3)), "y", ""]  # x and y in two classes
    assert (taught(names, [f"{a} {b} {'x' if a == b else 'y'}" for a in "ab" for b in "ab"])[2::4] > 0.8).all()


def test_group_sums_equal_reduceat_bit_for_bit():
    """Groups of one row, of some rows and of many, in a given order; no group reaches into the next."""
    rng = np.random.default_rng(5)
    for width, longest in ((32, 3), (64, 9), (5, 400)):
        lengths = rng.integers(1, longest + 1, 200)
        first, order = np.cumsum(lengths) - lengths, rng.permutation(lengths.sum())
        values = rng.normal(size=(len(order), width)).astype(np.float32)
        assert np.array_equal(maxent.group_sums(values, order, first), np.add.reduceat(values[order], first, axis=0))
    assert np.array_equal(maxent.group_sums(values, np.array([3]), np.array([0])), values[3:4])


def test_endings_follow_the_hash():
    for w in (b"", b"a", b"ab", b"abc", "größe".encode(), "日本".encode()):
        assert maxent.other_class(w) == maxent.CLASSES + crc32(w[-2:]) % maxent.OTHERS and maxent.key_of(w) == bytes([65 + crc32(w[-2:]) % maxent.OTHERS]) + w
        modelled = maxent.CLASSES * maxent.MEMBERS
        assert maxent.symbol_of(w) == modelled + crc32(w[-3:]) % (maxent.SYMBOLS - modelled - 1)
    endings = maxent.Endings(len)
    assert [endings[str(i).encode()] for i in (1, 22, 1)] == [1, 2, 1]
