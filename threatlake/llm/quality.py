"""Quality: attention-based multiple-instance learning over the passages of a text."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.llm.subwords import ngram_buckets, windows
from threatlake.llm.text import TEXT_BYTES, bounded_texts, chunks, interned, map_rows, remainder, text_bytes

#: Bound of the training sample: labelled texts of each class.
SAMPLE = 2000
#: Words of a passage, hashed dimensions of the encoding, width of the attention, steps of training.
PASSAGE, HASHED, WIDTH, STEPS = 64, 8, 12, 250
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_features(vocabulary: list[bytes]) -> np.ndarray:
    """Letter case, signs, digits and length of each word, and a signed random projection of its n-grams."""
    n = len(vocabulary)
    lengths = np.maximum(np.fromiter(map(len, vocabulary), np.int64, n), 1)
    flat = np.frombuffer(b"".join(w or b" " for w in vocabulary), np.uint8)
    starts = np.cumsum(lengths) - lengths
    count = lambda mask: np.add.reduceat(mask.astype(np.float32), starts) / lengths if n else np.zeros(0)
    upper, lower = (flat >= 65) & (flat <= 90), (flat >= 97) & (flat <= 122)
    sign, digit, wide = _SIGN[flat], (flat >= 48) & (flat <= 57), flat >= 128
    last, before = flat[starts + lengths - 1], flat[starts + np.maximum(lengths - 2, 0)]
    u, s, d = count(upper), count(sign), count(digit)
    columns = [u, count(lower), s, d, count(wide), np.minimum(lengths, 24) / 24.0, (lengths > 24).astype(float), s == 1, u > 0.5, d > 0.5,
               (lengths >= 2) & _SIGN[last] & _SIGN[before], _SIGN[last] & ~np.isin(last, list(b".,;:!?")), np.isin(last, list(b".!?")), np.isin(last, list(b",;:")),
               lengths <= 2]
    row, bucket = ngram_buckets(vocabulary, 3, 3, 12)
    table = np.random.default_rng(7).choice([-1.0, 1.0], (1 << 12, HASHED))
    size = np.maximum(np.bincount(row, minlength=n), 1)[:, None]
    projected = np.stack([np.bincount(row, table[bucket, k], n) for k in range(HASHED)], axis=1) / np.sqrt(size)
    return np.concatenate([np.stack([np.asarray(c, np.float32) for c in columns], axis=1), projected.astype(np.float32)], axis=1)


def encode(texts: list[bytes], passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(passage vectors, text of each): means of word features, then shares of words equal to the one, two or three before, and the length."""
    vectors, texts_of = [], []
    for a, b in chunks(texts):
        ids, lengths, vocabulary = interned([t.split() for t in texts[a:b]])
        if not len(ids):
            continue
        start, text = windows(lengths, passage)
        size = np.diff(np.append(start, len(ids)))
        owner = np.repeat(np.arange(len(start)), size)
        means = np.add.reduceat(word_features(vocabulary)[ids], start, axis=0) / size[:, None]
        again = [np.bincount(owner[k:], (ids[k:] == ids[:-k]) & (owner[k:] == owner[:-k]), len(start)) / size for k in (1, 2, 3)]
        vectors.append(np.concatenate([means, np.stack(again, axis=1), size[:, None] / passage], axis=1))
        texts_of.append(a + text)
    width = 15 + HASHED + 4
    return (np.concatenate(vectors), np.concatenate(texts_of)) if vectors else (np.zeros((0, width)), np.zeros(0, int))


def _sums(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(text, values, n)
    return np.stack([np.bincount(text, values[:, k], n) for k in range(values.shape[1])], axis=1)


@dataclass
class Quality:
    """Attention a = softmax over passages of w . (tanh(V h) * sigmoid(U h)); score = sigmoid(c . sum(a h) + b)."""

    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray
    passage: int
    prior: float = 0.5
    trace: list = field(default_factory=list)

    def forward(self, h: np.ndarray, text: np.ndarray, n: int):
        t, s = np.tanh(h @ self.v), 1 / (1 + np.exp(-np.clip(h @ self.u, -60, 60)))
        energy = (t * s) @ self.w
        top = np.full(n, -np.inf)
        np.maximum.at(top, text, energy)
        raised = np.exp(energy - top[text])
        a = raised / np.bincount(text, raised, n)[text]
        z = _sums(a[:, None] * h, text, n)
        return t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ self.c + self.b[0], -60, 60)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of good quality of each whole text; a text without words gets the prior of the training labels."""
        raw, text = encode(texts, self.passage)
        out = np.full(len(texts), self.prior)
        if len(text):
            present, index = np.unique(text, return_inverse=True)
            out[present] = self.forward((raw - self.mean) / self.scale, index, len(present))[-1]
        return out


def train(texts: list[bytes], labels: np.ndarray, prior: float = 0.5, passage: int = PASSAGE, width: int = WIDTH, steps: int = STEPS,
          seed: int = 42) -> Quality:
    """Full-batch Adam on the log loss over documents; classes weigh as ``prior`` says. One class alone gives a constant."""
    rng = np.random.default_rng(seed)
    raw, text = encode(texts, passage)
    labels = np.asarray(labels, float)
    d = raw.shape[1]
    model = Quality(raw.mean(axis=0) if len(raw) else np.zeros(d), raw.std(axis=0) + 1e-3 if len(raw) else np.ones(d), rng.normal(0, 0.2, (d, width)),
                    rng.normal(0, 0.2, (d, width)), rng.normal(0, 0.2, width), np.zeros(d), np.zeros(1), passage, prior)
    if len(np.unique(labels[text])) < 2:
        constant = float(labels[0]) if len(labels) else prior
        model.b[:] = np.log((constant + 0.01) / (1.01 - constant))
        model.prior = (constant + 0.01) / 1.02
        return model
    present, text = np.unique(text, return_inverse=True)
    y, n = labels[present], len(present)
    h = (raw - model.mean) / model.scale
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum())
    params = [model.v, model.u, model.w, model.c, model.b]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        t, s, a, z, p = model.forward(h, text, n)
        g = (p - y) * weight
        g_z = g[:, None] * model.c
        along = (h * g_z[text]).sum(axis=1)
        g_energy = a * (along - np.bincount(text, a * along, n)[text])
        g_t, g_s = g_energy[:, None] * model.w * s, g_energy[:, None] * model.w * t
        grads = [h.T @ (g_t * (1 - t * t)), h.T @ (g_s * s * (1 - s)), (t * s).T @ g_energy, z.T @ g, np.array([g.sum()])]
        for i, (value, grad) in enumerate(zip(params, grads, strict=True)):
            grad = grad + 1e-5 * value
            first[i] += 0.1 * (grad - first[i])
            second[i] += 0.001 * (grad * grad - second[i])
            value -= 0.03 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        model.trace.append(float(-(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum()))
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 4,
        held_out: int = 2, sample: int = SAMPLE, longest: int = TEXT_BYTES) -> Quality:
    """Learns from at most ``sample`` labelled texts of each class, those of lowest id hash, without texts of over ``longest`` bytes; so the
    driver holds at most 2 * ``sample`` * ``longest`` bytes. An id that repeats gives one text. Rows of the held-out fold,
    and rows without a label of 0 or 1, are never read. Equal texts of a class count once; the class shares that
    weigh the loss come from all labels of the training folds."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held_out)).distinct()
    share = known.agg(F.avg("label").alias("p")).first().p
    order = F.xxhash64("doc_id", "label")
    ids = [known.where(F.col("label") == k).orderBy(order).limit(sample) for k in (0, 1)]
    rows = bounded_texts(docs, doc_id, text, ids[0].union(ids[1]), longest).collect()
    rows = sorted({(bytes(r.text), r.label) for r in rows})
    return train([t for t, _ in rows], np.array([y for _, y in rows], int), 0.5 if share is None else min(max(share, 0.05), 0.95))


def score(docs: DataFrame, model: Quality, keep: list[str], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``keep`` columns, then score and predicted, for every row; null texts are empty, repeated rows score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep) if text in keep else docs.select(*keep, text_bytes(text).alias("__text"))

    def make():
        def work(batch):
            p = shared.value.score(batch["__text"])
            return {"score": p, "predicted": (p >= threshold).astype(np.int32)}
        return work

    return map_rows(rows, {"score": "double", "predicted": "int"}, keep, make, text if text in keep else None)
