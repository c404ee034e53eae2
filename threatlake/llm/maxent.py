"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax over n-gram and skip features."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.llm.storage import kept
from threatlake.llm.text import chunks, frequent, map_rows, remainder, text_bytes, words

#: Bound of the words with counts at hand in every task, classes of modelled words, words of such a class, classes of all other words.
HEAD, CLASSES, MEMBERS, OTHERS = 1 << 17, 16, 64, 16
#: History symbols (the modelled words, then hashed endings, then the start), rows of the hashed tables, rounds, tokens of a step, step size.
SYMBOLS, PAIR_ROWS, WORD_ROWS, ROUNDS, STEP, RATE = 2560, 1 << 13, 1 << 13, 3, 8192, 0.15
#: Rows of a table that travel together, words that a counting task holds before it hands them on, and words and bytes of a chunk.
ROWS, FLUSH = 1024, 1_000_000
#: Rows of a group up to which groups are added up side by side, and word endings remembered at most.
SIDE_BY_SIDE, ENDINGS = 8, 1 << 17


class Endings(dict):
    """What ``make`` makes of word endings, worked out once each."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, ending: bytes):
        if len(self) >= ENDINGS:
            self.clear()
        found = self[ending] = self.make(ending)
        return found


#: Letter and number of the class of other words by their last two bytes, history symbol of words that are not modelled by their last three.
LETTERS = Endings(lambda e: bytes([65 + crc32(e) % OTHERS]))
KINDS = Endings(lambda e: CLASSES + crc32(e) % OTHERS)
MARKS = Endings(lambda e: CLASSES * MEMBERS + crc32(e) % (SYMBOLS - CLASSES * MEMBERS - 1))


def key_of(word: bytes) -> bytes:
    """A letter for the class of other words, by the word's ending, then the word."""
    return LETTERS[word[-2:]] + word


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(key, c) over whole texts; the end of each text is the empty word. Tasks hand on partial counts of bounded size."""

    def count(batches):
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([key_of(w).decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["key", "c"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(words(t))
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield rows()
        yield rows()

    return docs.select(F.col(text)).mapInArrow(count, "key string, c long").groupBy("key").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the head words by rank, and of the classes of other words. Its size does not grow with the corpus."""

    head: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int
    other_total: np.ndarray
    other_once: np.ndarray

    def __post_init__(self):
        n, modelled = len(self.head), CLASSES * MEMBERS
        self.unseen = np.where(self.other_total > 0, np.clip((self.other_once + 0.5) / (self.other_total + 1.0), 1e-6, 0.5), 1.0)
        self.known = np.where(self.other_total > 0, (1 - self.unseen) / np.maximum(self.other_total, 1), 0.0)
        slots = np.zeros(modelled)
        slots[: min(n, modelled)] = self.counts[:modelled]
        slots = slots.reshape(CLASSES, MEMBERS)
        with np.errstate(divide="ignore"):
            inside = np.log(slots / np.maximum(slots.sum(axis=1, keepdims=True), 1))
            outside = np.log(np.concatenate([slots.sum(axis=1), self.other_total + 0.5]) / (slots.sum() + self.other_total.sum() + 0.5 * OTHERS))
        self.word_bias = np.maximum(inside, -1e4).astype(np.float32)
        self.class_bias = np.maximum(outside, -1e4).astype(np.float32)
        # class and symbol by rank; one more place for rank -1
        self.kinds, self.symbols = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for word, i in self.head.items():
            self.kinds[i], self.symbols[i] = (i // MEMBERS, i) if i < modelled else (other_class(word), symbol_of(word))

    @property
    def divisor(self) -> int:
        return self.total + self.distinct + 1


def build_vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Counts of at most ``head`` words leave the executors, and one row for each class."""
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = frequent(counts, "c", head).select("key", "c").toArrow().sort_by([("c", "descending"), ("key", "ascending")])
    keys, tops = [k.encode() for k in top["key"].to_pylist()], top["c"].to_numpy()
    by_class = counts.groupBy((F.ascii("key") - 65).alias("k")).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once")).collect()
    total, once = np.zeros(OTHERS), np.zeros(OTHERS)
    for r in by_class:
        total[r.k], once[r.k] = r.n, r.once
    for key, c in zip(keys[: CLASSES * MEMBERS], tops):
        total[key[0] - 65] -= c
        once[key[0] - 65] -= c == 1
    return Vocabulary({k[1:]: i for i, k in enumerate(keys)}, np.asarray(tops, np.int64), size.n or 0, size.v, total, once)


@dataclass
class Stream:
    """Tokens of a chunk of texts: words, then one end per text, with the symbols before them."""

    rank: np.ndarray  # place in the head, -1 for tail words
    kind: np.ndarray  # class
    one: np.ndarray  # previous symbol
    two: np.ndarray  # the symbol before that
    text: np.ndarray
    tail: list[bytes]  # tail words in order


def other_class(word: bytes) -> int:
    return KINDS[word[-2:]]


def symbol_of(word: bytes) -> int:
    """Symbol of a word that is not modelled."""
    return MARKS[word[-3:]]


def stream(vocabulary: Vocabulary, texts: list[bytes]) -> Stream:
    split = [words(t) for t in texts]
    for part in split:
        part.append(b"")
    flat = list(chain.from_iterable(split))
    rank = np.fromiter(map(vocabulary.head.get, flat, repeat(-1)), np.int64, len(flat))
    rare = np.flatnonzero(rank < 0)
    tail = [flat[i] for i in rare.tolist()]
    kind, symbol = vocabulary.kinds.take(rank, mode="wrap"), vocabulary.symbols.take(rank, mode="wrap")
    kind[rare] = [KINDS[w[-2:]] for w in tail]
    symbol[rare] = [MARKS[w[-3:]] for w in tail]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    text = np.repeat(np.arange(len(split)), lengths)
    one, two = np.empty_like(symbol), np.empty_like(symbol)
    one[1:], two[2:] = symbol[:-1], symbol[:-2]
    begin = np.cumsum(lengths) - lengths
    one[begin] = two[begin] = SYMBOLS - 1
    two[begin[lengths > 1] + 1] = SYMBOLS - 1
    return Stream(rank, kind, one, two, text, tail)


def group_sums(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows ``values[order]`` from each start up to the next. Most groups are short: their rows are added for all groups
    at once, in the order of ``reduceat``, which serves the longer ones."""
    lengths = np.diff(np.append(first, len(order)))
    sums = values.take(order.take(first), axis=0)
    short = np.flatnonzero((lengths > 1) & (lengths <= SIDE_BY_SIDE))
    short = short[np.argsort(-lengths[short], kind="stable")]  # the longest first, so those that go on are the leading ones
    if len(short):
        left, start = lengths[short], first[short]
        rest = values.take(order.take(start + 1), axis=0)
        for k in range(2, int(left[0])):
            n = int(np.searchsorted(-left, -k, side="left"))
            rest[:n] += values.take(order.take(start[:n] + k), axis=0)
        sums[short] += rest
    long = np.flatnonzero(lengths > SIDE_BY_SIDE)
    if len(long):
        inside = np.repeat(lengths > SIDE_BY_SIDE, lengths)
        sums[long] = np.add.reduceat(values.take(order[inside], axis=0), np.cumsum(lengths[long]) - lengths[long], axis=0)
    return sums


class Model:
    """Logits of a class = bias + rows of the previous symbol, of the one before it (a skip over one word) and of both together
    (hashed); logits of a member within its class = bias + hashed rows of (previous symbol, class) and (the one before, class)."""

    SHAPES = ((SYMBOLS * 2 + PAIR_ROWS, CLASSES + OTHERS), (WORD_ROWS * 2, MEMBERS))

    def __init__(self, vocabulary: Vocabulary, tables: list[np.ndarray] | None = None):
        self.vocabulary = vocabulary
        self.tables = tables or [np.zeros(s, np.float32) for s in self.SHAPES]

    @staticmethod
    def with_pair(table: int, rows: tuple) -> tuple:
        """Rows of a factor; the class factor has one more for the previous symbol and the one before together."""
        if table:
            return rows
        one, two = rows[0].astype(np.int64), rows[1].astype(np.int64) - SYMBOLS
        return *rows, SYMBOLS * 2 + ((one * 2_654_435_761 + two * 40_503 * 65_537) >> 7) % PAIR_ROWS

    def raised(self, table: int, rows: tuple, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, their exponentials, sums of these)."""
        rows = self.with_pair(table, rows)
        logits = self.tables[table].take(rows[0], axis=0)
        for r in rows[1:]:
            logits += self.tables[table].take(r, axis=0)
        logits += bias
        np.minimum(logits, 80, out=logits)
        e = np.exp(logits)
        return logits, e, e @ np.ones(e.shape[1], np.float32)

    def steps(self, s: Stream):
        """(table, rows, bias, target, tokens) of the class and of the member factor, some tokens at a time, sorted by the first row."""
        modelled = CLASSES * MEMBERS
        for a in range(0, len(s.rank), STEP):
            b = min(a + STEP, len(s.rank))
            at = a + np.argsort(s.one[a:b].astype(np.uint16), kind="stable")
            yield 0, (s.one[at], SYMBOLS + s.two[at]), self.vocabulary.class_bias, s.kind[at], at
            at = a + np.flatnonzero((s.rank[a:b] >= 0) & (s.rank[a:b] < modelled))
            if len(at):
                row = ((s.one[at] * CLASSES + s.kind[at]) * 2_654_435_761 >> 9) % WORD_ROWS
                order = np.argsort(row.astype(np.uint16), kind="stable")
                at = at[order]
                skip = WORD_ROWS + ((s.two[at] * CLASSES + s.kind[at]) * 2_246_822_519 >> 9) % WORD_ROWS
                yield 1, (row[order], skip), self.vocabulary.word_bias[s.kind[at]], s.rank[at] % MEMBERS, at

    def log_probs(self, s: Stream) -> np.ndarray:
        """Natural log of P(class | history), times P(word | class, history) for modelled words."""
        out = np.zeros(len(s.rank))
        for table, rows, bias, target, at in self.steps(s):
            logits, _, total = self.raised(table, rows, bias)
            out[at] += logits[np.arange(len(target)), target] - np.log(total)
        return out

    def learn(self, s: Stream, gathered: list[np.ndarray], seen: list[np.ndarray], rate: float = RATE) -> None:
        """Gradient steps over the tokens; ``gathered`` holds the squared gradients of each row, ``seen`` its tokens."""
        for table, rows, bias, target, _ in self.steps(s):
            _, g, total = self.raised(table, rows, bias)
            g /= total[:, None]
            g[np.arange(len(target)), target] -= 1
            weights, squares, count = self.tables[table], gathered[table], seen[table]
            for i, r in enumerate(self.with_pair(table, rows)):
                order = np.argsort(r.astype(np.uint16), kind="stable") if i else np.arange(len(r))
                r = r[order]
                first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                sums, hit = group_sums(g, order, first), r[first]
                squares[hit] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
                sums *= (rate / np.sqrt(squares[hit] + 1e-3))[:, None]
                weights[hit] = weights.take(hit, axis=0) - sums
                count[hit] += np.diff(np.append(first, len(r)))


def _train_round(rows: DataFrame, vocabulary, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Each task takes gradient steps over its texts from the shared tables; rows are then averaged by the tokens that moved them.

    The sums are formed on the executors, streaming, by blocks of rows; the driver gets one table of fixed size.
    """
    spark = rows.sparkSession
    given = spark.sparkContext.broadcast(tables)

    def work(batches):
        model = Model(vocabulary.value, [t.copy() for t in given.value])
        gathered = [np.zeros(len(t), np.float32) for t in model.tables]
        seen = [np.zeros(len(t), np.float32) for t in model.tables]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts, 1 << 21):
                model.learn(stream(model.vocabulary, texts[a:b]), gathered, seen)
        for n, (table, count) in enumerate(zip(model.tables, seen, strict=True)):
            for i in range(0, len(table), ROWS):
                if count[i : i + ROWS].any():
                    part = table[i : i + ROWS] * count[i : i + ROWS, None]
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary()),
                                                      pa.array([count[i : i + ROWS].tobytes()], pa.binary())], names=["n", "i", "part", "seen"])

    def add(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            for n, i, part, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = [np.frombuffer(part, np.float32).astype(np.float64), np.frombuffer(count, np.float32).astype(np.float64)]
                if (n, i) in held:
                    for total, x in zip(held[n, i], new, strict=True):
                        total += x
                else:
                    held[n, i] = new
        for (n, i), (part, count) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary()),
                                              pa.array([count.tobytes()], pa.binary())], names=["n", "i", "part", "seen"])

    schema = "n int, i int, part binary, seen binary"
    out = [t.copy() for t in tables]
    for r in rows.mapInArrow(work, schema).repartition("n", "i").mapInArrow(add, schema).collect():
        count = np.frombuffer(r.seen, np.float64)
        part = np.frombuffer(r.part, np.float64).reshape(len(count), -1)
        moved = count > 0
        block = out[r.n][r.i : r.i + len(count)]
        block[moved] = (part[moved] / count[moved, None]).astype(np.float32)
    return out


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; whole texts, null is empty.

    All texts outside the held-out fold are counted and trained on, each once, in ``rounds`` slices by id hash. Counts of
    the ``head`` most frequent words and the model tables have fixed sizes and are broadcast; all rarer words meet
    their counts in a shuffle join. A word that training has not seen is the unseen event of its class, of Good-Turing mass. An empty
    text is its end alone. Without training texts N and V are 0, the base score is 0 and classes are alike. Repeated rows
    are scored alike and train as often as they occur.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), (remainder(doc_id, folds) == held_out).alias("held_out"), text_bytes(text).alias("text"),
                       F.floor(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) / folds).alias("draw"))
    learned = rows.where(~F.col("held_out"))
    counts = kept(count_words(learned, "text"), "words")
    vocabulary = build_vocabulary(counts, head)
    shared = spark.sparkContext.broadcast(vocabulary)
    tables = Model(vocabulary).tables
    for r in range(rounds):
        tables = _train_round(learned.where(F.pmod("draw", F.lit(rounds)) == r).select("text"), shared, tables)
    given = spark.sparkContext.broadcast(tables)

    def make():
        v = shared.value
        model = Model(v, given.value)
        # log10 of the share in the class, 0 for modelled words, and of the base probability, by rank
        with np.errstate(divide="ignore"):
            share = np.log10(np.concatenate([v.counts, [1]]) * np.where(v.kinds < CLASSES, 0, v.known[v.kinds - CLASSES]))
        share[v.kinds < CLASSES] = 0
        base = np.log10((v.counts + 1) / v.divisor)

        def work(batch):
            out = {"n_tokens": [], "head_known": [], "head_base": [], "head_score": [], "tail": []}
            for a, b in chunks(batch["text"], 1 << 21):
                s = stream(v, batch["text"][a:b])
                n, inside = b - a, s.rank >= 0
                logs = model.log_probs(s) / math.log(10)
                place, of = s.rank[inside], s.text[inside]
                out["n_tokens"].append(np.bincount(s.text, minlength=n))
                out["head_known"].append(np.bincount(of, minlength=n))
                out["head_base"].append(np.bincount(of, base[place], n))
                out["head_score"].append(np.bincount(s.text, logs, n) + np.bincount(of, share[place], n))
                ends = np.cumsum(np.bincount(s.text[~inside], minlength=n))
                keys = [key_of(w).decode() for w in s.tail]
                out["tail"] += [keys[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            return {k: x if k == "tail" else np.concatenate(x) if x else [] for k, x in out.items()}
        return work

    parts = map_rows(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text"), {
        "n_tokens": "bigint", "head_known": "bigint", "head_base": "double", "head_score": "double", "tail": "array<string>"}, ["row", "doc_id", "held_out"], make)
    parts = kept(parts, "scored")
    by_class = lambda values: F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.ascii("key") - 64)
    c, d = F.coalesce("c", F.lit(0)), float(vocabulary.divisor)
    tail = parts.select("row", F.explode("tail").alias("key")).join(counts.hint("shuffle_hash"), "key", "left").select(
        "row", F.log10((c + 1) / F.lit(d)).alias("base"), (c > 0).cast("long").alias("known"),
        F.log10(F.when(c > 0, c * by_class(vocabulary.known)).otherwise(by_class(vocabulary.unseen))).alias("score"))
    tail = tail.groupBy("row").agg(F.sum("base").alias("tail_base"), F.sum("known").alias("tail_known"), F.sum("score").alias("tail_score"))
    zero = lambda name, value: F.coalesce(name, F.lit(value))
    return parts.drop("tail").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + zero("tail_known", 0)).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("tail_base", 0.0)).alias("base_score"), (F.col("head_score") + zero("tail_score", 0.0)).alias("score"))
