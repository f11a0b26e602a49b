"""Token counts of a unigram tokenizer, without the tokens.

Aho-Corasick lists the vocabulary's matches in a word by where they end, longest
first; dynamic programming carries to each place the best score and the number
of pieces on the way to it. Ties go to the piece that starts first, as in the
``tokenizers`` library, whose ``Unigram`` model with byte fallback is matched
exactly: a character that no piece covers alone may be unknown at the lowest
score less 10, and a run of unknown characters counts its UTF-8 bytes.

Texts are cut before each space as by ``Metaspace`` with a leading mark. The
vocabulary is read from a public file; its scores are taken as they stand.

Null or empty texts have 0 tokens. Each row is counted for itself.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from termwise.llm.texts import Memo, with_arrays

SPACE = "▁"
UNKNOWN_COST = 10.0
_WORDS = 200_000


def vocabulary(model: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores, and the id of the unknown piece, of a sentencepiece file."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=model)
    return [(pieces.id_to_piece(i), pieces.get_score(i)) for i in range(len(pieces))], pieces.unk_id()


class Counter:
    """Counts pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int):
        self.pieces, self.unknown = pieces, unknown

    def __getstate__(self):
        return {"pieces": self.pieces, "unknown": self.unknown}

    def open(self) -> None:
        self.matches = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(self.pieces):
            self.matches.add_word(piece, (len(piece), score, i == self.unknown))
        self.matches.make_automaton()
        self.penalty = min(score for _, score in self.pieces) - UNKNOWN_COST
        self.alone = {piece for piece, _ in self.pieces if len(piece) == 1}
        self.words = Memo(self.count_word, _WORDS)

    def count_word(self, word: str) -> int:
        n = len(word)
        ending: list[list] = [[] for _ in range(n + 1)]
        for end, match in self.matches.iter(word):
            ending[end + 1].append(match)
        # By place: score, pieces before the open run of unknowns, its bytes, whether it is one unknown piece.
        best: list[tuple[float, int, int, bool] | None] = [(0.0, 0, 0, False)] + [None] * n
        for end in range(1, n + 1):
            top = None
            for length, score, unknown in sorted(ending[end], key=lambda x: -x[0]):
                score, before = score + best[end - length][0], best[end - length]
                if top is None or score > top[0]:
                    top = (score, before, length, unknown)
            if word[end - 1] not in self.alone:
                score = self.penalty + best[end - 1][0]
                if top is None or score > top[0]:
                    top = (score, best[end - 1], 0, True)
            score, before, length, unknown = top
            if unknown:
                size = len(word[end - max(length, 1):end].encode())
                best[end] = (score, before[1], before[2] + size, length > 0 and not before[2])
            else:
                best[end] = (score, _closed(before) + 1, 0, False)
        return _closed(best[n])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not hasattr(self, "words"):
            self.open()
        parts = text.replace(SPACE, " ").split(" ")
        # A leading space is the leading mark.
        return sum(map(self.words.__getitem__, [SPACE + x for x in (parts if text[0] not in (" ", SPACE) else parts[1:])]))


def _closed(state: tuple[float, int, int, bool]) -> int:
    """Pieces with the open run of unknowns counted: its bytes, or one for the unknown piece by itself."""
    return state[1] + (1 if state[3] else state[2])


def token_counts(docs: DataFrame, counter: Counter, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` from ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(counter)

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([shared.value.count(x) for x in texts.to_pylist()], pa.int64())]

    return with_arrays(docs, "n_tokens long", compute, keep)
