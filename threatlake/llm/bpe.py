"""Byte-level BPE encoding and decoding: a transducer lexicon for frequent words, exact merges for all others."""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.llm.storage import kept, write_shared
from threatlake.llm.text import frequent, map_rows

#: Words of the lexicon, and words whose ids a task remembers, at most.
LEXICON_WORDS, REMEMBERED = 131_072, 500_000
#: Bytes of a word up to which its pairs are searched rather than queued, and the rank of a pair that never merges.
SHORT, NEVER = 40, (1 << 60, -1)
#: Words merged side by side, by their longest lengths, and at a time.
WIDTHS, SIDE_BY_SIDE = (8, 16, SHORT), 16_384

#: Fixed value: the published pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of ASCII characters only.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Vocabulary:
    """Ids, merge ranks and added tokens of a byte-level BPE file."""

    def __init__(self, content: dict):
        model, letters = content["model"], byte_letters()
        if model["type"] != "BPE" or content["pre_tokenizer"]["type"] != "ByteLevel" or content["normalizer"]:
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        back = {c: b for b, c in letters.items()}
        ids = model["vocab"]
        self.byte_ids = [ids[letters[b]] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        self.added = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes_of = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.none = len(self.bytes_of)  # stands for no id beside the others
        pairs = np.array([[left * (self.none + 1) + right, rank, new] for (left, right), (rank, new) in self.merges.items()], np.int64).reshape(-1, 3)
        self.pair_codes, self.pair_ranks = pairs[(by := np.argsort(pairs[:, 0])), 0], pairs[by, 1]
        self.made = np.zeros(int(pairs[:, 1].max(initial=-1)) + 1, np.int64)
        self.made[pairs[:, 1]] = pairs[:, 2]
        self.words = regex.compile(PATTERN)
        self.breaks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is an added token, piece) in order."""
        parts = self.breaks.split(text) if self.breaks else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield True, part
            else:
                for word in self.cut(part):
                    yield False, word

    def cut(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        return (PLAIN if text.isascii() else self.words).findall(text)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: the pair of lowest rank is merged first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in word]
        n, merges = len(ids), self.merges
        if n <= SHORT:  # a look at all pairs is cheaper than keeping them in order
            get = merges.get
            found = [get(pair, NEVER) for pair in zip(ids, ids[1:])]
            while found and (best := min(found)) is not NEVER:
                i = found.index(best)
                ids[i : i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = get((ids[i - 1], ids[i]), NEVER)
                if i < len(found):
                    found[i] = get((ids[i], ids[i + 1]), NEVER)
            return tuple(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return tuple(x for x in ids if x >= 0)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, the number of ranks for pairs that never merge."""
        code = left * (self.none + 1) + right
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], len(self.made))

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of many words: short ones take their merges side by side, one of each word at a time."""
        out, lengths = [()] * len(words), np.fromiter(map(len, words), np.int64, len(words))
        width_of = np.searchsorted(WIDTHS, lengths)
        for k, width in enumerate(WIDTHS if len(self.pair_codes) else ()):
            chosen = np.flatnonzero((width_of == k) & (lengths > 0))
            for a in range(0, len(chosen), SIDE_BY_SIDE):
                self._merge_short([words[i] for i in chosen[a : a + SIDE_BY_SIDE]], chosen[a : a + SIDE_BY_SIDE], lengths, width, out)
        for i in np.flatnonzero((width_of == len(WIDTHS)) | (len(self.pair_codes) == 0)):
            out[i] = self.merge(words[i])
        return out

    def _merge_short(self, words: list[bytes], place: np.ndarray, lengths: np.ndarray, width: int, out: list) -> None:
        left_over, columns = lengths[place], np.arange(width)
        ids = np.full((len(words), width + 1), self.none, np.int64)
        ids[:, :-1][columns < left_over[:, None]] = np.asarray(self.byte_ids)[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            open_ = best < len(self.made)
            if not open_.all():
                for i, row, n in zip(place[~open_].tolist(), ids[~open_].tolist(), left_over[~open_].tolist(), strict=True):
                    out[i] = tuple(row[:n])
                if not open_.any():
                    return
                ids, ranks, place, left_over, at, best = ids[open_], ranks[open_], place[open_], left_over[open_], at[open_], best[open_]
            rows, later = np.arange(len(at)), columns > at[:, None]
            ids[:, 1:-1] = np.where(later[:, 1:], ids[:, 2:], ids[:, 1:-1])  # what follows the pair moves up
            ranks[:, :-1] = np.where(later[:, 1:], ranks[:, 1:], ranks[:, :-1])
            ids[rows, at] = self.made[best]
            left_over = left_over - 1
            ranks[rows, at] = self.ranks(ids[rows, at], ids[rows, at + 1])
            inner = np.flatnonzero(at)
            ranks[inner, at[inner] - 1] = self.ranks(ids[inner, at[inner] - 1], ids[inner, at[inner]])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Lexicon:
    """Minimal acyclic transducer over words as bytes, laid out in one block that can be memory-mapped.

    States share suffixes. An arc carries a byte, a target and a number; the numbers along a word's path add up to the
    word's place in sorted order, which leads to its ids. Block: six counts, then arrays of 32-bit words: first arc of
    each state, final flags, arc bytes, arc targets, arc numbers, first id of each word, ids.
    """

    def __init__(self, block):
        states, arcs, words, ids = (int(x) for x in np.frombuffer(block, np.int32, 4))
        sizes = [states + 1, states, arcs, arcs, arcs, words + 1, ids]
        at, parts = 16, []
        for n in sizes:
            parts.append(np.frombuffer(block, np.int32, n, at))
            at += 4 * n
        self.first, self.final, self.byte, self.target, self.number, self.start, self.ids = parts
        self.block = block

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @staticmethod
    def compile(entries: dict[bytes, tuple[int, ...]]) -> bytes:
        """Built from sorted words; each state is replaced by an equal one already known as soon as it is complete."""
        known: dict[tuple, int] = {}
        done: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def freeze(state) -> int:
            key = (state[0], tuple(state[1]))
            if key not in known:
                known[key] = len(done)
                done.append(key)
            return known[key]

        path, last = [[False, []]], b""
        ordered = sorted(entries)

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                child = freeze(path.pop())
                path[-1][1].append((last[len(path) - 1], child))

        for word in ordered:
            close(len(os.path.commonprefix([word, last])))
            path.extend([False, []] for _ in range(len(word) - len(path) + 1))
            path[-1][0] = True
            last = word
        close(0)
        root = freeze(path[0])

        below: list[int] = []
        for final, arcs in done:  # children are frozen before their parents
            below.append(final + sum(below[t] for _, t in arcs))
        first, byte, target, number = [0], [], [], []
        for final, arcs in done:
            passed = int(final)
            for b, t in arcs:
                byte.append(b)
                target.append(t)
                number.append(passed)
                passed += below[t]
            first.append(len(byte))
        starts = np.cumsum([0, *(len(entries[w]) for w in ordered)])
        ids = [i for w in ordered for i in entries[w]]
        parts = [[len(done), len(byte), len(ordered), len(ids)], first, [int(f) for f, _ in done], byte, target, number, starts, ids]
        assert root == len(done) - 1
        return b"".join(np.asarray(p, np.int32).tobytes() for p in parts)

    def find(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """Ids of each word, None for unknown words; all words walk together, a byte at a time."""
        n = len(words)
        if not n:
            return []
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat, offset = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        if not hasattr(self, "codes"):  # arcs of a state are sorted by byte, so state * 256 + byte is sorted over all arcs
            self.codes = np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first)) * 256 + self.byte
        state, rank = np.full(n, len(self.final) - 1, np.int64), np.zeros(n, np.int64)
        alive, at = np.flatnonzero(lengths > 0), 0
        ok = lengths == 0
        while len(alive) and len(self.codes):
            code = state[alive] * 256 + flat[offset[alive] + at]
            arc = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[arc] == code
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.target[arc]
            rank[alive] += self.number[arc]
            at += 1
            over = lengths[alive] == at
            ok[alive[over]] = True
            alive = alive[~over]
        ok &= self.final[state] > 0
        begin, end, ids = self.start[rank * ok], self.start[(rank + 1) * ok], self.ids
        return [tuple(ids[a:b].tolist()) if good else None for good, a, b in zip(ok, begin, end, strict=True)]


class Encoder:
    """Ids of texts: lexicon first, merges for the rest; what ``form`` makes of the ids of recent words is remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, form=tuple):
        self.vocabulary, self.lexicon, self.form = vocabulary, lexicon, form
        self.memory: dict[str, object] = {}

    def formed_batch(self, texts: list[str]) -> list[list]:
        """For each text, the forms of its words and added tokens in order."""
        vocabulary, memory, form = self.vocabulary, self.memory, self.form
        split, new = [], {}
        for text in texts:
            if vocabulary.breaks and vocabulary.breaks.search(text):
                parts = [(piece,) if added else piece for added, piece in vocabulary.pieces(text)]
            else:
                parts = vocabulary.cut(text)
            split.append(parts)
            new.update(dict.fromkeys(parts))
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
        new = [w for w in new if w not in memory]
        plain = [w for w in new if isinstance(w, str)]
        coded = [w.encode() for w in plain]
        found = self.lexicon.find(coded) if self.lexicon else [None] * len(coded)
        missed = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missed, vocabulary.merge_all([coded[i] for i in missed]), strict=True):
            found[i] = ids
        memory.update(zip(plain, map(form, found), strict=True))
        for token in new:
            if isinstance(token, tuple):
                memory[token] = form((vocabulary.added[token[0]],))
        return [list(map(memory.__getitem__, parts)) for parts in split]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, for the form that is the ids themselves."""
        return [list(chain.from_iterable(got)) for got in self.formed_batch(texts)]


def digest_form(vocabulary: Vocabulary):
    """What digests need of a word: number of ids, ids as text, decoded bytes."""
    name, raw = [str(i) for i in range(vocabulary.none)].__getitem__, vocabulary.bytes_of.__getitem__
    return lambda ids: (len(ids), ",".join(map(name, ids)), b"".join(map(raw, ids)))


def digests_of(got: list[tuple[int, str, bytes]]) -> tuple[int, str, str]:
    """(number of ids, sha256 of the ids, sha256 of the decoded text)."""
    if not got:
        return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
    n, ids, decoded = zip(*got, strict=True)
    text = b"".join(decoded).decode("utf-8", "replace")
    return sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", size: int = LEXICON_WORDS) -> DataFrame:
    """(word, n): the most frequent words over all texts, at most ``size``."""
    pattern, breaks, flush = PATTERN, "|".join(map(regex.escape, vocabulary.added)), REMEMBERED

    def count(batches):
        words, split, seen = regex.compile(pattern), regex.compile(breaks) if breaks else None, Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in split.split(text) if split else [text]:
                    seen.update((PLAIN if part.isascii() else words).findall(part))
                if len(seen) > flush:
                    yield rows()
                    seen.clear()
        yield rows()

    parts = docs.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(count, "word string, n long")
    return frequent(kept(parts.groupBy("word").agg(F.sum("n").alias("n")), "words"), "n", size)


def publish_lexicon(docs: DataFrame, vocabulary_path: str, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compiles the lexicon of the corpus and makes the file known to all executors; returns its name there."""
    spark, vocabulary = docs.sparkSession, Vocabulary.read(vocabulary_path)
    top = frequent_words(docs, vocabulary, text, size).select("word").toArrow()["word"].to_pylist()
    path = write_shared(spark, "lexicon", Lexicon.compile({w.encode(): vocabulary.merge(w.encode()) for w in top}))
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def encode_decode(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
                  size: int = LEXICON_WORDS, digests: bool = False) -> DataFrame:
    """``keep`` columns (default: doc_id), then ids (array of int) and decoded (string) per row.

    Null texts are empty; empty texts have no ids. Strings of added tokens in a text become those tokens, as the
    tokenizers library does. Whole texts of any length are encoded; every row, repeated or not, gives one row.
    With ``digests`` the columns are n_tokens, ids_sha256 and decoded_sha256 instead, so ids need not leave the task.
    ``vocabulary_path`` is read on the driver; its content travels as a broadcast of the file's fixed size.
    """
    keep = keep or [doc_id]
    name = publish_lexicon(docs, vocabulary_path, text, size)
    with open(vocabulary_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    source = "__text"
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(source))

    def make():
        vocabulary = Vocabulary(json.loads(content.value))
        encoder = Encoder(vocabulary, Lexicon.open(SparkFiles.get(name)), digest_form(vocabulary) if digests else tuple)

        def work(batch):
            texts, out = batch[source], {"ids": [], "decoded": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for i in range(0, len(texts), 512):
                if digests:
                    for got in encoder.formed_batch(texts[i : i + 512]):
                        for k, x in zip(("n_tokens", "ids_sha256", "decoded_sha256"), digests_of(got), strict=True):
                            out[k].append(x)
                else:
                    for ids in encoder.encode_batch(texts[i : i + 512]):
                        out["ids"].append(ids)
                        out["decoded"].append(vocabulary.decode(ids))
            return out
        return work

    columns = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} if digests else {"ids": "array<int>", "decoded": "string"}
    return map_rows(rows, columns, keep, make)
