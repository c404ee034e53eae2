"""Toxicity: averaged subword embeddings and a linear softmax, trained jointly."""

from __future__ import annotations

from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.llm.subwords import ngram_buckets, windows
from threatlake.llm.text import TEXT_BYTES, bounded_texts, chunks, interned, map_rows, remainder, text_bytes, words

#: Bound of the training sample: labelled texts of each class.
SAMPLE = 1500
#: Words of a passage, width of the embeddings, bits of the n-gram table, steps of training.
PASSAGE, DIM, BITS, STEPS = 24, 3, 21, 50
#: Lengths of the n-grams, and training words that an n-gram needs (a word counts once per text) to get a vector.
SHORTEST, LONGEST, SEEN = 3, 5, 6
#: Step size, and decay of the n-gram vectors: chance words of a few toxic texts pull less than this, toxic words far more.
RATE, DECAY = 0.15, 1e-6
_EDGE = bytes(set(range(33, 127)) - set(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def bare(word: bytes) -> bytes:
    """A word without the ASCII signs around it; a word of signs stays whole."""
    return word.strip(_EDGE) or word


def squeezed(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids and text lengths with runs of one word taken as one word, so that no passage is a single repeated word."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (text[1:] != text[:-1])
    return ids[new], np.bincount(text[new], minlength=len(lengths))


@dataclass
class Toxicity:
    """Word vector = mean of its n-gram vectors, passage vector = mean of its word vectors, then a two-class softmax."""

    grams: np.ndarray  # (2 ** bits, dim)
    weights: np.ndarray  # (dim, 2)
    bias: np.ndarray  # (2,)
    passage: int
    slope: float = 1.0
    offset: float = 0.0
    line: np.ndarray | None = None  # toxic minus clean logit of each n-gram, where only scores are wanted

    def compact(self) -> Toxicity:
        """The same scores without the embeddings: one number per n-gram."""
        line = (self.grams @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)
        return replace(self, grams=np.zeros((len(self.grams), 0), np.float32), line=line)

    def word_margins(self, vocabulary: list[bytes]) -> np.ndarray:
        """Toxic minus clean logit of each word, without bias: the average over a passage commutes with the linear layer."""
        bits = int(self.grams.shape[0]).bit_length() - 1
        row, bucket = ngram_buckets([bare(w) for w in vocabulary], SHORTEST, LONGEST, bits)
        line = self.grams @ (self.weights[:, 1] - self.weights[:, 0]) if self.line is None else self.line
        total = np.bincount(row, line[bucket], len(vocabulary))
        return total / np.maximum(np.bincount(row, minlength=len(vocabulary)), 1)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Largest softmax margin (toxic minus clean) over the passages of each whole text; passages overlap by half.
        Empty texts: the bias alone."""
        out = np.full(len(texts), -np.inf)
        base = float(self.bias[1] - self.bias[0])
        for a, b in chunks(texts):
            ids, lengths, vocabulary = interned([words(t) for t in texts[a:b]])
            ids, lengths = squeezed(ids, lengths)
            margin = np.concatenate([[0.0], np.cumsum(self.word_margins(vocabulary)[ids])])
            ends = np.cumsum(lengths)
            start, text = windows(lengths, self.passage // 2)
            stop = np.minimum(start + self.passage, ends[text])
            mean = (margin[stop] - margin[start]) / np.maximum(stop - start, self.passage // 2)
            np.maximum.at(out, a + text, mean + base)
        out[np.isneginf(out)] = base
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probability that a text is toxic."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -500, 500)))

    def calibrate(self, texts: list[bytes], labels: np.ndarray, prior: float = 0.5) -> None:
        """Logistic fit of slope and offset on texts that training has not seen; ``prior`` is the weight of the toxic ones."""
        m, y = self.margins(texts), np.asarray(labels, float)
        if not 0 < y.sum() < len(y):
            return
        weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum())
        center, width = (m * weight).sum(), max(m.std(), 1e-9)
        x, a, b = (m - center) / width, 1.0, 0.0
        for _ in range(50):  # Newton steps with a small ridge, so that separable data give finite values
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
            h = weight * p * (1 - p)
            grad = np.array([((p - y) * weight * x).sum() + 1e-3 * a, ((p - y) * weight).sum()])
            a, b = np.array([a, b]) - np.linalg.solve([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]], grad).clip(-1, 1)
        self.slope, self.offset = a / width, b - a * center / width


def train(texts: list[bytes], labels: np.ndarray, passage: int = PASSAGE, dim: int = DIM, bits: int = BITS, steps: int = STEPS,
          seed: int = 42) -> Toxicity:
    """Full-batch Adam on embeddings and softmax together.

    In the first half of the steps every passage of a toxic text counts as toxic; then only its worst passage does,
    so innocent words of toxic texts are not blamed. Both classes weigh alike. One class alone gives a constant model.
    """
    rng = np.random.default_rng(seed)
    model = Toxicity(rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32), rng.normal(0, 0.5, (dim, 2)), np.zeros(2), passage)
    labels = np.asarray(labels)
    if len(labels) == 0 or labels.min() == labels.max():
        model.grams[:] = 0
        model.bias[:] = (0, 4 if len(labels) and labels[0] else -4)
        return model
    ids, lengths, vocabulary = interned([[bare(w) for w in words(t)] for t in texts])
    ids, lengths = squeezed(ids, lengths)
    start, text = windows(lengths, passage)
    owner = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))
    size = np.maximum(np.bincount(owner, minlength=len(start)), passage // 2).astype(float)
    row, bucket = ngram_buckets(vocabulary, SHORTEST, LONGEST, bits)
    per_word = np.bincount(row, minlength=len(vocabulary)).astype(float)
    in_text = np.unique(np.repeat(np.arange(len(texts)), lengths) * len(vocabulary) + ids) % len(vocabulary)
    spread_over = np.bincount(bucket, np.bincount(in_text, minlength=len(vocabulary))[row], 1 << bits)
    common = (spread_over >= SEEN)[bucket]
    row, bucket = row[common], bucket[common]
    used, bucket = np.unique(bucket, return_inverse=True)
    grams = model.grams[used].astype(np.float64)
    params = [grams, model.weights, model.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    y = labels[text]

    def spread(index, values, picked, n):
        """Sums of the picked rows of ``values`` by index; one column of picked values is held at a time."""
        return np.stack([np.bincount(index, values[picked, k], n) for k in range(values.shape[1])], axis=1)

    for step in range(1, steps + 1):
        word = spread(row, grams, bucket, len(vocabulary)) / per_word[:, None]
        mean = spread(owner, word, ids, len(start)) / size[:, None]
        logit = mean @ model.weights + model.bias
        p = 1 / (1 + np.exp(np.clip(logit[:, 0] - logit[:, 1], -500, 500)))
        weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
        if step > steps // 2:
            best = np.full(len(texts), -1.0)
            np.maximum.at(best, text, p)
            kept = (y == 0) | (p >= best[text])
            weight = np.where(kept, np.where(y == 1, 0.5 / max((kept & (y == 1)).sum(), 1), weight), 0)
        g = ((p - y) * weight)[:, None] * np.array([-1.0, 1.0])
        g_mean = g @ model.weights.T / size[:, None]
        g_word = spread(ids, g_mean, owner, len(vocabulary)) / per_word[:, None]
        grads = [spread(bucket, g_word, row, len(used)) + DECAY * grams, mean.T @ g + 1e-5 * model.weights, g.sum(axis=0)]
        for i, (value, grad) in enumerate(zip(params, grads, strict=True)):
            first[i] += 0.1 * (grad - first[i])
            second[i] += 0.02 * (grad * grad - second[i])
            value -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.98**step)) + 1e-9)
    model.grams[:] = 0
    model.grams[used] = grams
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5,
        held_out: int = 0, sample: int = SAMPLE, longest: int = TEXT_BYTES) -> Toxicity:
    """Learns from at most ``sample`` labelled texts of each class, those of lowest id hash, without texts of over ``longest`` bytes; so the
    driver holds at most 2 * ``sample`` * ``longest`` bytes. An id that repeats gives one text. Rows of the held-out fold,
    and rows without a label of 0 or 1, are never read. Equal texts of a class count once; the share of toxic labels that
    calibrates the score comes from all labels of the training folds."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held_out)).distinct()
    share = known.agg(F.avg("label").alias("p")).first().p
    order = F.xxhash64("doc_id", "label")
    ids = [known.where(F.col("label") == k).orderBy(order).limit(sample) for k in (0, 1)]
    rows = bounded_texts(docs, doc_id, text, ids[0].union(ids[1]), longest).collect()
    seen = {(bytes(r.text), r.label) for r in rows}
    rows = sorted(seen)
    return learn([t for t, _ in rows], np.array([y for _, y in rows], int), balance(share or 0.0))


def balance(share: float) -> float:
    """Weight of the toxic class at calibration: halfway, in log odds, between its share and equal weight, so that neither
    missed toxic texts nor rejected clean ones are bought cheaply."""
    share = min(max(share, 0.01), 0.99)
    odds = (share / (1 - share)) ** 0.5
    return odds / (1 + odds)


def learn(texts: list[bytes], labels: np.ndarray, prior: float = 0.5) -> Toxicity:
    """Trains on four of five texts, by their hash, and calibrates on the fifth; ``prior`` is the weight of toxic texts there."""
    apart = np.array([crc32(t) % 5 == 4 for t in texts], bool)
    model = train([t for t, x in zip(texts, apart, strict=True) if not x], labels[~apart])
    model.calibrate([t for t, x in zip(texts, apart, strict=True) if x], labels[apart], prior)
    return model


def score(docs: DataFrame, model: Toxicity, keep: list[str], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``keep`` columns, then score and predicted, for every row; null texts are empty, repeated rows score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model.compact())
    rows = docs.select(*keep) if text in keep else docs.select(*keep, text_bytes(text).alias("__text"))

    def make():
        def work(batch):
            p = shared.value.score(batch["__text"])
            return {"score": p, "predicted": (p >= threshold).astype(np.int32)}
        return work

    return map_rows(rows, {"score": "double", "predicted": "int"}, keep, make, text if text in keep else None)
