"""Language identification: known words first, character n-grams for the rest.

A word (a run of letters, lower-cased) that is among the known ones scores its
log frequency in each language. Any other word falls back to its 4-grams, with
marks for its ends; if none of them is known, to 3-grams, 2-grams and letters.
Its score is the mean over the known n-grams. A text's score for a language is
the sum over its words, and ``score`` the share of the best language in the
softmax of these sums.

Counts cover every training text. The tables that go to the tasks are bounded by
the number of languages: the ``KNOWN`` most frequent words of each language, and
the ``GRAMS`` most frequent n-grams of each language and n. So no language, and
no n, takes the room of another.

With ``least``, a text is ``und`` where less than that share of its letters is in
words that are known or fall back to a known n-gram of two letters or more; the
pipeline rejects by ``LEAST``. Ends of words count as letters of an n-gram.

Null or empty texts, or texts without a letter: ``und`` with score 0, as all
texts when nothing was learned. Ties go to the language first in code-point
order. Null languages or texts teach nothing; repeated rows count each time.
"""

from __future__ import annotations

import gc
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termwise.llm.texts import with_arrays, written

KNOWN, GRAMS, UNSEEN = 60_000, 60_000, 200_000
LEAST = 0.1
_BUCKETS = 32
ORDERS = (4, 3, 2, 1)
UNDECIDED = "und"
_WORDS = regex.compile(r"\p{L}+")
_PART = 100_000


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [word[i:i + 1] for i in range(len(word))] if n == 1 else [
        marked[i:i + n] for i in range(max(1, len(marked) - n + 1))]


def _rows(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
         pa.array([counts[k] for k in keys], pa.int64())], ["lang", "item", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gc.collect()
    by_lang: dict[str, Counter] = defaultdict(Counter)
    held = 0

    def flush():
        for lang, counts in by_lang.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()),
                 pa.array(list(counts.values()), pa.int64())], ["lang", "item", "n"])
        by_lang.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            before = len(by_lang[lang])
            by_lang[lang].update(words_of(text))
            held += len(by_lang[lang]) - before
            if held > _PART:
                yield from flush()
                held = 0
    yield from flush()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gc.collect()
    counts: Counter = Counter()
    for batch in batches:
        for lang, word, n in zip(*(batch.column(x).to_pylist() for x in ("lang", "item", "n"))):
            for order in ORDERS:
                for gram in grams_of(word, order):
                    counts[lang, gram] += n
            if len(counts) > _PART:
                yield _rows(counts)
                counts.clear()
    if counts:
        yield _rows(counts)


class _Places(dict):
    """Rows of known words; any other word gets the next free one, its score and its letters that are told."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        row = self.model.rows[place]
        row[:-1], order = self.model.unseen(word)
        row[-1] = len(word) if order > 1 else 0
        return place


class LanguageModel:
    """Per-language log frequencies of the known words and n-grams."""

    def __init__(self, langs: list[str], words: dict[str, list[int]], grams: dict[str, list[int]],
                 totals: list[int]):
        self.langs = langs
        self.words = list(words)
        self.table = self._logs(list(words.values()), totals, len(words))
        by_order = defaultdict(dict)
        for gram, counts in grams.items():
            by_order[len(gram)][gram] = counts
        # Places in one array: a tuple of floats each would take five times the room, in every worker.
        self.grams, logs = {}, [np.zeros((0, len(langs)))]
        for found in by_order.values():
            sums = [sum(x) for x in zip(*found.values())]
            logs.append(self._logs(list(found.values()), sums, len(found)))
            self.grams |= {gram: len(self.grams) + i for i, gram in enumerate(found)}
        self.gram_logs = np.concatenate(logs)

    def _logs(self, counts: list[list[int]], totals: list[int], kinds: int) -> np.ndarray:
        if not counts:
            return np.zeros((0, len(self.langs)))
        return np.log((np.array(counts, float) + 0.5) / (np.array(totals, float) + 0.5 * kinds + 0.5))

    def unseen(self, word: str) -> tuple[np.ndarray, int]:
        """The score of a word that is not a known one, by language, and the n of the n-grams that gave it, or 0."""
        for order in ORDERS:
            if found := [x for g in grams_of(word, order) if (x := self.grams.get(g)) is not None]:
                return self.gram_logs[found].sum(axis=0) / len(found), order
        return np.zeros(len(self.langs)), 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("at", "rows")}

    def _open(self) -> None:
        # Models of earlier jobs, which their caches hold in cycles, go first.
        gc.collect()
        self.rows = np.zeros((len(self.words) + UNSEEN, len(self.langs) + 1))
        self.rows[:len(self.words), :-1] = self.table
        self.rows[:len(self.words), -1] = [len(w) for w in self.words]
        self.at = _Places({w: i for i, w in enumerate(self.words)})
        self.at.model = self

    def places(self, words: list[str]) -> np.ndarray:
        """Rows of ``self.rows`` for at most ``UNSEEN`` words; those held go when room for all might lack."""
        if not hasattr(self, "at") or len(self.at) + len(words) > len(self.rows):
            self._open()
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None], least: float = 0.0) -> tuple[list[str], list[float]]:
        best, shares = [], []
        for text in texts:
            words = words_of(text)
            if not words or not self.langs:
                best.append(UNDECIDED)
                shares.append(0.0)
                continue
            sums = np.zeros(len(self.langs) + 1)
            for i in range(0, len(words), UNSEEN):
                part = self.places(words[i:i + UNSEEN])
                sums += self.rows[part].sum(axis=0)
            sums, told = sums[:-1], sums[-1]
            if least and (not told or told < least * sum(map(len, words))):
                best.append(UNDECIDED)
                shares.append(0.0)
                continue
            top = int(sums.argmax())
            best.append(self.langs[top])
            shares.append(1 / math.fsum(np.exp(sums - sums[top])))
        return best, shares


def _most(rows: DataFrame, limit: int, langs: list[str], kind: Column) -> dict[str, list[int]]:
    """Counts by language of the items that are among a language's ``limit`` most frequent of their kind."""
    rank = F.row_number()
    by_count = [F.col("n").desc(), "item"]
    own = Window.partitionBy("lang", "kind", F.pmod(F.xxhash64("item"), F.lit(_BUCKETS))).orderBy(*by_count)
    # Ranked in buckets first, so that what a task ranks does not grow with the corpus.
    items = (rows.withColumn("kind", kind)
             .withColumn("rank", rank.over(own)).filter(F.col("rank") <= limit)
             .withColumn("rank", rank.over(Window.partitionBy("lang", "kind").orderBy(*by_count)))
             .filter(F.col("rank") <= limit).select("item").distinct())
    sums = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]
    found = rows.join(items, "item", "left_semi").groupBy("item").agg(*sums).toArrow()
    counts = [found.column(f"n{i}").to_pylist() for i in range(len(langs))]
    return {item: list(x) for item, *x in sorted(zip(found.column("item").to_pylist(), *counts))}


def fit(train: DataFrame, known: int = KNOWN, grams: int = GRAMS) -> LanguageModel:
    """Learns from (text, lang); rows with a null in either teach nothing.

    What comes to the driver is one row per language and the bounded tables.
    """
    rows = train.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = written(
        rows.mapInArrow(_count_words, "lang string, item string, n long")
        .groupBy("lang", "item").agg(F.sum("n").alias("n")), "words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals, key=lambda x: x.encode())
    if not langs:
        return LanguageModel([], {}, {}, [])
    pieces = written(
        counts.mapInArrow(_count_grams, "lang string, item string, n long")
        .groupBy("lang", "item").agg(F.sum("n").alias("n")), "grams")
    return LanguageModel(langs, _most(counts, known, langs, F.lit(0)),
                         _most(pieces, grams, langs, F.length("item")),
                         [totals[x] for x in langs])


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """``docs`` with lang_pred and score, from ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        best, shares = shared.value.predict(texts.to_pylist(), least)
        return [pa.array(best, pa.string()), pa.array(shares, pa.float64())]

    return with_arrays(docs, "lang_pred string, score double", compute, keep)
