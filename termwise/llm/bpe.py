"""Byte-pair encoding by a deterministic automaton, and decoding by its arc labels.

The automaton reads tokens; a state is the token read last. It starts with the
single bytes, each allowed after each. Merge ``k`` of ``a`` and ``b`` into ``c``
adds a gadget: ``b`` no longer follows ``a``, and state and symbol ``c`` appear;
``c`` is followed by what followed ``b`` before the merge and follows what ``a``
follows after it. (For ``a = b`` that makes runs merge from the left.) What the
last automaton accepts is what the merges, applied in order, would leave, and a
text has one such path.

Written out, the forbidden arcs of 50,000 merges pass thirty million, most of
them inherited. So a gadget keeps its own arc in the table and points to the
states it inherits from; a transition follows those pointers, a few at most, and
is kept once known.

A word is encoded over its prefixes: the state that reaches a prefix is its one
token ``t`` that the state before ``t`` allows. Decoding joins the byte labels
of the arcs; bytes that are no UTF-8 become U+FFFD, as in the library.

Null or empty texts have no ids; null ids decode to the empty text. Strings of
added tokens in a text become their ids.
"""

from __future__ import annotations

import json
import re
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from termwise.llm.texts import Memo, with_arrays

# Fixed: the pattern that cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
# What the pattern makes of a word of Latin letters and marks behind it: a line's start, the word, the marks.
_SIMPLE = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_CHUNKS, _WORDS, _ARCS, _WIDE, LONGEST = 150_000, 50_000, 200_000, 32, 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in set(shown)):
        letters[chr(0x100 + n)] = b
    return letters


class Automaton:
    """States and symbols are token ids; labels their bytes."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]], added: dict[str, int]):
        size = max([*tokens.values(), *added.values(), -1]) + 1
        self.tokens, self.added = tokens, added
        self.labels = [b""] * size
        for label, i in tokens.items():
            self.labels[i] = label
        for text, i in added.items():
            self.labels[i] = text.encode()
        self.longest = max(map(len, tokens), default=1)
        self.born = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.stands = [len(x) == 1 for x in self.labels]
        self.arcs: dict[tuple[int, int], int] = {}
        for step, (a, b) in enumerate(merges):
            self._gadget(step, tokens[a], tokens[b], tokens[a + b])

    def _gadget(self, step: int, a: int, b: int, c: int) -> None:
        if self.born[c] >= 0 or self.stands[c]:
            raise ValueError(f"two merges make {self.labels[c]!r}")
        # Without a path over both there is nothing to merge, and c is never reached.
        self.stands[c] = self.stands[a] and self.stands[b] and self.allows(a, b, step)
        self.arcs[a, b] = step
        self.born[c], self.left[c], self.right[c] = step, a, b

    @classmethod
    def compile(cls, tokenizer_json: str) -> Automaton:
        model = json.loads(tokenizer_json)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[x] for x in token)

        added = {x["content"]: x["id"] for x in model["added_tokens"]}
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
        tokens = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in added}
        return cls(tokens, [(raw(a), raw(b)) for a, b in merges], added)

    def allows(self, state: int, symbol: int, limit: int | None = None) -> bool:
        """Whether ``symbol`` may follow ``state``, before merge ``limit`` or after all."""
        born, arcs = self.born, self.arcs
        limit = len(self.labels) if limit is None else limit
        while True:
            step = arcs.get((state, symbol))
            if step is not None and step < limit:
                return False
            s, y = born[state], born[symbol]
            if s < 0 and y < 0:
                return True
            if s >= y:
                state, limit = self.right[state], min(limit, s)
            else:
                symbol, limit = self.left[symbol], min(limit, y + 1)

    def encode_word(self, word: bytes) -> list[int]:
        n, longest, get, go = len(word), self.longest, self.whole.get, self.go
        if (only := get(word)) is not None:
            return [only]
        # The longest token that the one before allows, else a shorter one. One token ends the path to a prefix, so a
        # prefix from which nothing leads on is left for good.
        out, ends, dead = [], [0], set()
        limit = min(n, longest)
        while (at := ends[-1]) < n:
            before = out[-1] << _WIDE if out else -1
            for end in range(limit, at, -1):
                token = get(word[at:end])
                if token is not None and end not in dead and (before < 0 or go[before | token]):
                    out.append(token)
                    ends.append(end)
                    limit = min(n, end + longest)
                    break
            else:
                dead.add(at)
                out.pop()
                limit = ends.pop() - 1
        return out

    def open(self) -> None:
        """What is looked up while encoding, made in the process that encodes."""
        self.go = Memo(lambda arc: self.allows(arc >> _WIDE, arc & (1 << _WIDE) - 1), _ARCS)
        self.cut = regex.compile(PATTERN)
        # Tokens that a word made of them alone can end as.
        self.whole = {label: token for label, token in self.tokens.items() if self.stands[token]}
        self.words = Memo(self._word, _WORDS, LONGEST)
        self.chunks = Memo(self._chunk, _CHUNKS, LONGEST)
        self.specials = (regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)))
                         if self.added else None)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("go", "cut", "words", "chunks", "specials", "whole")}

    def _word(self, word: str) -> bytes:
        return array("i", self.encode_word(word.encode())).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        found = _SIMPLE.fullmatch(chunk)
        if found is None:
            return b"".join([self.words[x] for x in self.cut.findall(chunk)])
        line, word, marks = found.groups()
        if not line and not marks:
            return self._word(word)
        # Words are kept among the chunks, where they stand alone too.
        return (self.words[line] if line else b"") + self.chunks[word] + (self.words[marks] if marks else b"")

    def _plain(self, text: str) -> bytes:
        # A run of white space and what follows it is cut alike wherever it stands.
        if _OTHER_SPACE.search(text):
            return b"".join(map(self.words.__getitem__, self.cut.findall(text)))
        return b"".join(map(self.chunks.__getitem__, _PLAIN.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian i4."""
        if not hasattr(self, "chunks"):
            self.open()
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.specials.finditer(text):
            out.append(self._plain(text[at:found.start()]))
            out.append(np.array([self.added[found.group()]], "<i4").tobytes())
            at = found.end()
        out.append(self._plain(text[at:]))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return text_of(self.labels, ids)


def text_of(labels: list[bytes], ids: list[int]) -> str:
    return b"".join(map(labels.__getitem__, ids)).decode("utf-8", "replace")


def automaton(tokenizer: str) -> Automaton:
    return Automaton.compile(Path(tokenizer).read_text())


def _ids(rules: Automaton, texts: pa.Array) -> pa.Array:
    runs = [rules.encode(x) if x else b"" for x in texts.to_pylist()]
    offsets = np.cumsum([0, *(len(x) // 4 for x in runs)])
    ids = pa.array(np.frombuffer(b"".join(runs), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)


def _decoded(labels: list[bytes], ids: pa.Array) -> pa.Array:
    offsets, values = ids.offsets.to_pylist(), ids.values.to_numpy()
    return pa.array([text_of(labels, values[lo:hi].tolist()) for lo, hi in zip(offsets, offsets[1:])], pa.string())


def encode(docs: DataFrame, rules: Automaton, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids array<int>`` from ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)
    return with_arrays(docs, "ids array<int>", lambda texts: [_ids(shared.value, texts)], keep)


def round_trip(docs: DataFrame, rules: Automaton, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids array<int>`` from ``text`` and the text ``decoded`` from them.

    `decode` of `encode` gives the same, but keeps two Python workers for each task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def compute(texts: pa.Array) -> list[pa.Array]:
        ids = _ids(shared.value, texts)
        return [ids, _decoded(shared.value.labels, ids)]

    return with_arrays(docs, "ids array<int>, decoded string", compute, keep)


def decode(rows: DataFrame, rules: Automaton, name: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``rows`` with the text of ``ids``. Only the labels go to the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(rules.labels)
    return with_arrays(rows, f"{name} string", lambda ids: [_decoded(shared.value, ids)], keep, reads="ids")
