"""Token counts without tokens: Aho-Corasick matches of a unigram vocabulary and a count-only Viterbi pass."""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.llm.text import map_rows

#: Words whose result a task remembers, at most; and what an unknown character scores below the worst piece.
REMEMBERED, UNKNOWN, LOWEST = 500_000, 10.0, float("-inf")
#: Mark that stands for a space.
MARK = "▁"


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """(score, pieces) of the best segmentation.

    Of equal scores the segmentation whose last piece starts first wins at each place: places are filled from left to
    right and a later one must be better. A character that is no piece may stand alone at ``UNKNOWN`` below the lowest
    score and then counts one piece per UTF-8 byte. Pieces never reach over the start of a word, so words are solved
    one by one and remembered.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        self.memory: dict[str, tuple[float, int]] = {}

    def word(self, word: str) -> tuple[float, int]:
        """Matches come by their end, longest first, that is by their start; a place is closed when the matches move past it."""
        n, unknown = len(word), self.unknown
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        place, single = 0, True  # the place being filled, and whether a one-character piece ends there
        for last, (length, score) in self.automaton.iter(word):
            if last >= place:
                if not single:
                    self._alone(word, place, best, count)
                for skipped in range(place + 1, last + 1):
                    best[skipped] = LOWEST
                    self._alone(word, skipped, best, count)
                place, single = last + 1, False
                best[place] = LOWEST
            total = best[place - length] + score
            if total > best[place]:
                best[place], count[place] = total, count[place - length] + 1
            if length == 1:
                single = True
        if not single:
            self._alone(word, place, best, count)
        for skipped in range(place + 1, n + 1):
            best[skipped] = LOWEST
            self._alone(word, skipped, best, count)
        return best[n], count[n]

    def _alone(self, word, place, best, count):
        total = best[place - 1] + self.unknown
        if total > best[place]:
            best[place], count[place] = total, count[place - 1] + len(word[place - 1].encode())

    def text(self, text: str) -> tuple[float, int]:
        """Each space becomes a mark, a mark is put in front unless there is one; a word runs from a mark to the next."""
        if not text:
            return 0.0, 0
        parts = text.replace(" ", MARK).split(MARK)
        if not parts[0]:
            parts = parts[1:]
        memory, total, n = self.memory, 0.0, 0
        if len(memory) > REMEMBERED:
            memory.clear()
        for part in parts:
            found = memory.get(part)
            if found is None:
                found = memory[part] = self.word(MARK + part)
            total += found[0]
            n += found[1]
        return total, n


def token_counts(docs: DataFrame, vocabulary_path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns (default: doc_id), then n_tokens and best_score of every whole text.

    Null and empty texts have no tokens and score 0. The vocabulary is read on the driver and broadcast; its size is fixed.
    """
    keep = keep or ["doc_id"]
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary_path))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def make():
        counter = UnigramCounter(pieces.value)

        def work(batch):
            found = [counter.text(t) for t in batch["__text"]]
            return {"n_tokens": np.array([n for _, n in found], np.int64), "best_score": np.array([s for s, _ in found], np.float64)}
        return work

    return map_rows(rows, {"n_tokens": "bigint", "best_score": "double"}, keep, make)
