"""Fill-in-middle: texts are cut at token boundaries that a learned rank index holds, and their three parts change places.

The index of a text maps a rank (number of tokens before a boundary) to the boundary's offset in code points. Straight pieces,
each within an error bound, predict the offset; the stored residual of the boundary makes the prediction exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.llm.text import map_rows

#: Marks before prefix, suffix and middle; seed; percent of texts that change, and of those with the suffix first.
MARKS, SEED, RATE, SUFFIX_FIRST = ("<P>", "<S>", "<M>"), 42, 50, 80
#: Largest error of a straight piece in code points (a residual fits a byte), and boundaries tried at first for a piece.
BOUND, WINDOW = 120, 512


def boundaries(text: str) -> np.ndarray:
    """Offsets 0, end of token 1, end of token 2 and so on of the tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``.

    A token ends where a word ends; white space after the last word is one more token. The empty text has offset 0 alone.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(1, np.int64)
    inside = (points != 32) & ((points < 9) | (points > 13))
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return np.concatenate(([0], ends, [len(points)])).astype(np.int64)


@dataclass(frozen=True)
class RankIndex:
    """Straight pieces over the ranks (first rank, offset there, offset per rank) and one residual per rank."""

    ranks: np.ndarray
    offsets: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, bound: int = BOUND) -> RankIndex:
        """Pieces as long as the bound allows, from left to right: a piece starts on a boundary and goes on while one slope
        keeps all its boundaries within ``bound``. Windows double, so a boundary is looked at a few times at most."""
        starts, slopes, at, last = [], [], 0, len(offsets) - 1
        while at <= last:
            size, fits = WINDOW, 0
            while True:
                run = np.arange(1, min(size, last - at) + 1)
                rise = offsets[at + 1 : at + 1 + len(run)] - offsets[at]
                low, high = np.maximum.accumulate((rise - bound) / run), np.minimum.accumulate((rise + bound) / run)
                out = np.flatnonzero(low > high)
                fits = int(out[0]) if len(out) else len(run)
                if len(out) or at + fits == last:
                    break
                size *= 2
            starts.append(at)
            slopes.append((low[fits - 1] + high[fits - 1]) / 2 if fits else 0.0)
            at += fits + 1
        ranks = np.array(starts, np.int64)
        bare = cls(ranks, offsets[ranks], np.array(slopes), np.zeros(0, np.int16))
        return cls(bare.ranks, bare.offsets, bare.slopes, (offsets - bare.predict(np.arange(len(offsets)))).astype(np.int16))

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        piece = np.searchsorted(self.ranks, ranks, "right") - 1
        return self.offsets[piece] + np.rint(self.slopes[piece] * (ranks - self.ranks[piece])).astype(np.int64)

    def at(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of the boundaries of these ranks."""
        return self.predict(ranks) + self.residuals[ranks]

    @property
    def tokens(self) -> int:
        return len(self.residuals) - 1


def _rows(docs: DataFrame, doc_id: str, text: str, seed: int, keep: list[str], made: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Kept columns (none named like an output), the text (null: empty) and four numbers drawn from the id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"__h{i + 1}") for i in range(4)]
    kept = [k for k in keep if k not in made]
    return docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"), *draws), kept


def rank_indexes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = BOUND) -> DataFrame:
    """(doc_id, n, pieces, residuals) per row: the learned index of each text, to be stored and cut from later.

    ``pieces`` holds (rank, offset, slope); ``residuals`` one whole number per boundary. The empty or null text has one boundary.
    """
    def make():
        def work(batch):
            found = [RankIndex.fit(boundaries(t), bound) for t in batch["__text"]]
            return {"n": [x.tokens for x in found], "residuals": [x.residuals for x in found],
                    "pieces": [[{"rank": r, "offset": o, "slope": s} for r, o, s in zip(x.ranks.tolist(), x.offsets.tolist(), x.slopes.tolist(), strict=True)]
                               for x in found]}
        return work

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return map_rows(rows, {"n": "bigint", "pieces": "array<struct<rank:bigint,offset:bigint,slope:double>>", "residuals": "array<smallint>"}, ["doc_id"], make)


def _worker(bound: int, rate: int, suffix_first: int, marks: tuple[str, str, str]) -> Callable[[], Callable[[dict], dict]]:
    p, s, m = marks

    def make():
        def work(batch):
            out = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output")}
            for text, h1, h2, h3, h4 in zip(*(batch[k] for k in ("__text", "__h1", "__h2", "__h3", "__h4")), strict=True):
                index = RankIndex.fit(boundaries(text), bound)
                n, form, a, b, output = index.tokens, "plain", None, None, text
                if text and h3 % 100 < rate and not any(x in text for x in marks):
                    a, b = index.at(np.array(sorted((h1 % (n + 1), h2 % (n + 1))))).tolist()
                    form = "spm" if h4 % 100 < suffix_first else "psm"
                    parts = (s, text[b:], p, text[:a], m, text[a:b]) if form == "spm" else (p, text[:a], s, text[b:], m, text[a:b])
                    output, b = "".join(parts), b - a
                for k, v in zip(out, (n, form, a, b, output), strict=True):
                    out[k].append(v)
            return out
        return work

    return make


MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, seed: int = SEED, rate: int = RATE,
                   suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, bound: int = BOUND) -> DataFrame:
    """``keep`` columns (default: the id) and n, form, prefix_chars, middle_chars, output of every row; one pass, no shuffle.

    A text of n tokens is cut after two numbers of tokens drawn from sha256 of ``seed:id``; ``rate`` percent of the texts change,
    ``suffix_first`` percent of those in the order suffix, prefix, middle (spm), the others prefix, suffix, middle (psm).
    Empty and null texts and texts that hold a mark stay plain, with null lengths. A null id counts as the empty id; rows of equal id
    and text give equal results. Texts of any length are read whole, their tokens cost memory of the task alone. Other columns
    are not looked at; a kept column that is named like an output is left out. An empty table gives an empty one.
    """
    rows, kept = _rows(docs, doc_id, text, seed, [doc_id] if keep is None else keep, MADE)
    columns = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}
    return map_rows(rows, columns, kept, _worker(bound, rate, suffix_first, marks))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. A changed text holds no mark, so each mark is found where it was put."""
    p, s, m = (F.lit(x) for x in marks)
    head, middle = F.split_part(output, m, F.lit(1)), F.split_part(output, m, F.lit(2))
    psm = F.concat(F.split_part(F.split_part(head, s, F.lit(1)), p, F.lit(2)), middle, F.split_part(head, s, F.lit(2)))
    spm = F.concat(F.split_part(head, p, F.lit(2)), middle, F.split_part(F.split_part(head, p, F.lit(1)), s, F.lit(2)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


#: The rows of ``op11_infill`` for another engine.
SQL = r"""WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  w AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
      CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
  c AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM w),
  p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid,
      coalesce(array_to_string(w[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
