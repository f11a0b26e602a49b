"""Cut documents into overlapping chunks and keep a chunk table up to date."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chunk size and overlap in characters, and where a text may be cut.
CHUNK_SIZE, CHUNK_OVERLAP = 800, 100
CUTS = ("\n\n", "\n", ". ", " ")
# Fixed value: what stands between excerpts.
CONTEXT_RULE = "\n\n---\n\n"

# Characters of finished chunks a task holds before handing them on.
FLUSH_CHARS = 8_000_000


def text_cutter(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, cuts=CUTS) -> Callable[[str], list[str]]:
    """A function from one text to its chunks.

    The coarsest cut present is tried first; a cut stays at the head of the piece
    after it. Neighbouring pieces are packed up to ``size``, the next chunk
    starting with at most ``overlap`` characters of whole pieces from the last.
    A piece that is itself too long is cut again by the finer cuts; a run
    without any cut is left whole.
    """

    def pieces(text: str, cut: str) -> list[str]:
        starts, at = [0], text.find(cut)
        while at != -1:
            starts.append(at)
            at = text.find(cut, at + len(cut))
        spans = [text[a:b] for a, b in zip(starts, starts[1:] + [len(text)])]
        return [s for s in spans if s]

    def pack(parts: list[str]) -> Iterator[str]:
        # parts[lo:hi] is the open chunk and width its length.
        lo, width = 0, 0
        for hi, part in enumerate(parts):
            if width + len(part) > size and hi > lo:
                yield "".join(parts[lo:hi])
                while width > overlap or (width > 0 and width + len(part) > size):
                    width -= len(parts[lo])
                    lo += 1
            width += len(part)
        yield "".join(parts[lo:])

    def cut_up(text: str, level: int) -> Iterator[str]:
        while level < len(cuts) - 1 and cuts[level] not in text:
            level += 1
        run: list[str] = []
        for piece in pieces(text, cuts[level]):
            if len(piece) < size:
                run.append(piece)
                continue
            if run:
                yield from pack(run)
                run = []
            if level + 1 < len(cuts):
                yield from cut_up(piece, level + 1)
            else:
                yield piece
        if run:
            yield from pack(run)

    def cut(text: str) -> list[str]:
        return [c for c in (chunk.strip() for chunk in cut_up(text, 0)) if c]

    return cut


def chunk_documents(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``(source, text)`` to ``(source, chunk, chunk_id, text)``; one row is one document.

    Chunks number from 0 within a source and ``chunk_id`` is the source's stem and
    that number. Stems can collide, so the key is ``(source, chunk)``.
    """
    cut = text_cutter(size, overlap)
    flush_chars = FLUSH_CHARS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sources, numbers, texts, held = [], [], [], 0
            for source, text in zip(batch["source"], batch["text"]):
                for number, chunk in enumerate(cut(text) if text else ()):
                    sources.append(source)
                    numbers.append(number)
                    texts.append(chunk)
                    held += len(chunk)
                if held > flush_chars:
                    yield pd.DataFrame({"source": sources, "chunk": numbers, "text": texts})
                    sources, numbers, texts, held = [], [], [], 0
            if texts:
                yield pd.DataFrame({"source": sources, "chunk": numbers, "text": texts})

    cut_rows = documents.select(F.col("source").cast("string"), "text").mapInPandas(
        run, "source string, chunk int, text string")
    stem = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"(?<=.)\.[^.]+$", "")
    return cut_rows.select(
        "source", "chunk", F.concat(stem, F.lit("_"), F.col("chunk").cast("string")).alias("chunk_id"), "text")


_ENCODERS: dict[str, Callable] = {}


def _encoder(name: str, make_encoder: Callable[[], Callable]) -> Callable:
    """The worker's encoder of that name; another name takes its place."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = make_encoder()
    return _ENCODERS[name]


def hashing_encoder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An encoder without a model: each word adds or takes one at a place its MD5 names."""

    def encode(texts: list[str]) -> list[list[float]]:
        vectors = np.zeros((len(texts), width))
        for vector, text in zip(vectors, texts):
            for word in re.findall("[a-z0-9]+", text.lower()):
                digest = hashlib.md5(word.encode()).hexdigest()
                vector[int(digest[:4], 16) % width] += 1 if int(digest[4], 16) % 2 else -1
        return vectors.tolist()

    return encode


def embed_chunks(chunks: DataFrame, make_encoder: Callable[[], Callable], name: str | None = None) -> DataFrame:
    """Add ``embedding``; the encoder is given lists of texts.

    It is made once per task, or, where it has a ``name``, once per worker, so
    that a model is not loaded again for every task.
    """
    columns = [f for f in chunks.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(name, make_encoder) if name else make_encoder()
        for batch in batches:
            batch = batch.copy()
            batch["embedding"] = [[float(x) for x in v] for v in encode(batch["text"].tolist())]
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", embedding array<float>"
    return chunks.mapInPandas(run, schema)


def upsert_chunks(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Replace every re-loaded source; a source that yields no chunk keeps its old ones."""
    fresh = loaded.select("source").distinct()
    return stored.join(fresh, "source", "left_anti").unionByName(loaded)


def list_sources(chunks: DataFrame) -> DataFrame:
    """The loaded sources in order, with their chunk counts."""
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks")).orderBy("source")


def assemble_context(ranked: DataFrame, by: str = "query_id", rank: str = "rank", text: str = "text") -> DataFrame:
    """One row per query: its few retrieved texts in rank order, ruled apart."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(rank), F.col(text))))
    return ranked.groupBy(by).agg(
        F.array_join(F.transform(ordered, lambda r: r[text]), CONTEXT_RULE).alias("context"),
        F.count(F.lit(1)).alias("n_excerpts"),
    )
