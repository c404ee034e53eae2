"""BPE against the tokenizers library, token counts against its unigram model."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm.conftest import ODD
from threatlake.llm import bpe, counts

BPE_FILE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["it's  they've\t\n  x", "日本語のテキスト 😀👨‍👩‍👧 é", "a" * 3000, "123 4567,89.0 !!!??? <|endoftext|><|endoftext|> end", "naïve Straße été\r\n\r\n  two   spaces ",
         "  odd spaces　", "<|endoftext", "don'T I'M", "ﬁ ½ ² Ⅷ"]


def rows_of(sf_rows):
    return ODD + [(100 + i, t, "z") for i, t in enumerate(TEXTS)] + sf_rows


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return [(1000 + r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.mark.parametrize("size", [50, 65_536])
def test_bpe_equals_library(documents, sample, size):
    t = Tokenizer.from_file(BPE_FILE)
    rows = rows_of(sample)
    got = bpe.encode_decode(documents(rows), BPE_FILE, keep=["doc_id", "source"], size=size).collect()
    text = {d: x or "" for d, x, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        want = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.decoded == t.decode(want, skip_special_tokens=False) == text[r.doc_id]


def test_bpe_digests_and_empty_table(documents):
    r = bpe.encode_decode(documents([(1, "hello world", "s")]), BPE_FILE, digests=True).first()
    ids = Tokenizer.from_file(BPE_FILE).encode("hello world").ids
    assert (r.n_tokens, r.ids_sha256) == (2, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert r.decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    assert bpe.encode_decode(documents([]).where("false"), BPE_FILE).count() == 0


def test_words_merged_side_by_side_equal_single_merges():
    """Words of all lengths, in the widths that are merged together and beyond them, in any order."""
    rng, vocabulary = random.Random(7), bpe.Vocabulary.read(BPE_FILE)
    asked = ["".join(rng.choices("aeinst hou_'.-019éß日😀", k=rng.randint(1, 45))).encode() for _ in range(3000)] + [b"", b"a", b"a" * 40, b"a" * 41, b"ab" * 900]
    assert vocabulary.merge_all(asked) == [vocabulary.merge(w) for w in asked]
    assert vocabulary.merge_all([]) == []


def test_ascii_words_equal_the_published_pattern():
    rng, vocabulary = random.Random(8), bpe.Vocabulary.read(BPE_FILE)
    for _ in range(2000):
        text = "".join(rng.choices("abst'relv 01.!\t\n\x0b\x1c\x1f\x7f<|>", k=rng.randint(0, 40)))
        assert vocabulary.cut(text) == vocabulary.words.findall(text)


def test_digests_equal_library(documents, sample):
    t, rows = Tokenizer.from_file(BPE_FILE), rows_of(sample)
    text = {d: x or "" for d, x, _ in rows}
    got = bpe.encode_decode(documents(rows), BPE_FILE, digests=True, size=50).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_lexicon_is_minimal_and_finds_exactly_its_words():
    rng = random.Random(4)
    entries = {bytes(rng.choices(b"abc", k=rng.randint(1, 7))): tuple(rng.choices(range(99), k=rng.randint(0, 4))) for _ in range(400)}
    entries |= {s + b"ing": (1, 2) for s in (b"walk", b"talk", b"jump")}
    lexicon = bpe.Lexicon(bpe.Lexicon.compile(entries))
    asked = [*entries, b"", b"zzz", b"walki", b"walkingx", b"abcabcabcabc"]
    assert lexicon.find(asked) == [entries.get(w) for w in asked]
    seen, right = set(), {}
    for state in range(len(lexicon.final)):  # no two states accept the same endings
        arcs = range(lexicon.first[state], lexicon.first[state + 1])
        right[state] = (bool(lexicon.final[state]), tuple((int(lexicon.byte[a]), right[int(lexicon.target[a])]) for a in arcs))
        assert right[state] not in seen
        seen.add(right[state])
    assert bpe.Lexicon(bpe.Lexicon.compile({})).find([b"a"]) == [None]


def test_counts_equal_library(documents, sample):
    t = Tokenizer(models.Unigram(counts.read_pieces(PIECES), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = rows_of(sample)
    got = counts.token_counts(documents(rows), PIECES).collect()
    text = {d: x or "" for d, x, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(t.encode(text[r.doc_id], add_special_tokens=False).ids), text[r.doc_id][:80]
    assert counts.token_counts(documents([]).where("false"), PIECES).count() == 0


def test_viterbi_ties_go_to_the_earlier_start():
    pieces = [("<unk>", 0.0), ("▁a", -1.0), ("b", -1.0), ("▁", -1.0), ("ab", -1.0), ("▁ab", -2.0), ("<0x63>", -3.0)]
    counter = counts.UnigramCounter(pieces)
    assert counter.text("ab") == (-2.0, 1) and counter.text("b b") == (-4.0, 4) and counter.text("") == (0.0, 0)
    assert counter.text("é") == (-1.0 + -3.0 - 10.0, 3)
