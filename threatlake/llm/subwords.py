"""Hashed byte n-grams of words, for whole lists of words at once."""

from __future__ import annotations

import numpy as np

#: Odd multiplier that spreads n-gram codes over buckets (the golden ratio in 64 bits).
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(words: list[bytes], low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket), as short integers, of every n-gram of ``<word>`` with low <= n <= high, and of the whole word."""

    def bucketed(codes):
        mixed = codes * _SPREAD
        return ((mixed ^ (mixed >> np.uint64(31))) * _SPREAD >> np.uint64(64 - bits)).astype(np.int32)

    marked = [b"<" + w + b">" for w in words]
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(marked), dtype=np.int32), lengths)
    left = ends[owner] - np.arange(len(flat)) if len(flat) else np.zeros(0, np.int64)
    rows, buckets = [], []
    code = np.zeros(len(flat), np.uint64)
    for n in range(1, high + 1):
        code = code[: max(len(flat) - n + 1, 0)] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(n)
        if n >= low:
            inside = left[: len(code)] >= n
            rows.append(owner[: len(code)][inside])
            buckets.append(bucketed(code[inside]))
    if len(marked):  # the whole word: a sum of its bytes weighed by place, apart from all n-grams
        place = np.arange(len(flat), dtype=np.uint64) - np.repeat(ends - lengths, lengths).astype(np.uint64)
        power = (place * np.uint64(2) + np.uint64(1)) * _SPREAD
        mixed = (flat + np.uint64(17)) * (power ^ (power >> np.uint64(29)))
        rows.append(np.arange(len(marked), dtype=np.int32))
        buckets.append(bucketed(np.add.reduceat(mixed, ends - lengths) ^ np.uint64(0x5DEECE66D)))
    empty = [np.zeros(0, np.int32)]
    return np.concatenate(rows or empty), np.concatenate(buckets or empty)


def windows(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window, text of each window): runs of ``size`` words, the last one shorter; an empty text has none."""
    starts = np.cumsum(lengths) - lengths
    per = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return starts[text] + number * size, text
