"""Token ids in files of patched frame-of-reference blocks.

A file row is a segment: some documents in ascending id order, whole, with
their lengths and one payload. The payload holds blocks of ``BLOCK`` ids: each
keeps its minimum, packs the differences to it at the width that ``FIT`` of
them fit, and lists the outliers with their places; an index gives the start of
every block, so one block can be read without the others.

Payload, little-endian: u32 mark, u64 ids, u32 blocks; by block u32 minimum, u8
width, u8 outliers, u32 start of its packed words; then all packed words (u64),
then the outliers' places (u8) and differences (u32). The last block is filled
up with its own minimum.

Segments are rows of a Parquet table: Spark writes and commits them, so a lost
executor leaves no half-written file, and any store that Spark reaches will do.

Null or empty texts hold the end id only. A null id sorts first. Rows of one id
follow each other in the order of their texts' hashes. A segment ends at the
first document that brings it to ``SEGMENT`` ids, however long that document.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from termwise.llm.bpe import byte_letters
from termwise.llm.texts import Memo, parts

BLOCK, SEGMENT, FIT, MARK = 128, 1 << 17, 0.9, 0x31524650
_KEEP, LONGEST = 200_000, 64
# Lower-case letters that a normalizer to composed, lower-case form leaves alone, and ASCII marks after them.
_LETTERS = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_ASCII = re.compile(rb"([a-z]+)([!-/:-@\[-`{-~]*)")
_SHIFTS = np.uint64(1) << np.arange(33, dtype=np.uint64)


def pack(ids: np.ndarray) -> bytes:
    """The payload of a run of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = struct.pack("<IQI", MARK, n, blocks)
    if not n:
        return head
    rows = np.empty(blocks * BLOCK, np.uint64)
    rows[:n] = ids
    rows[n:] = rows[(blocks - 1) * BLOCK:n].min()
    rows = rows.reshape(blocks, BLOCK)
    least = rows.min(axis=1)
    rows -= least[:, None]
    # The difference at the wanted rank of each block gives its width.
    rank = int(np.ceil(FIT * BLOCK)) - 1
    widths = np.searchsorted(_SHIFTS, np.partition(rows, rank, axis=1)[:, rank], side="right").astype(np.uint8)
    out = rows >= _SHIFTS[widths][:, None]
    found, places = np.nonzero(out)
    values = rows[found, places].astype("<u4")
    rows[found, places] = 0
    words = 2 * widths.astype(np.int64)
    starts = np.cumsum(words) - words
    area = np.zeros(int(words.sum()), "<u8")
    for width in np.unique(widths[widths > 0]).tolist():
        at = np.nonzero(widths == width)[0]
        columns = np.ascontiguousarray(rows[at].T)
        packed = np.zeros((2 * width, len(at)), np.uint64)
        for i in range(BLOCK):
            word, shift = divmod(i * width, 64)
            packed[word] |= columns[i] << np.uint64(shift)
            if shift + width > 64:
                packed[word + 1] |= columns[i] >> np.uint64(64 - shift)
        area[starts[at][:, None] + np.arange(2 * width)] = packed.T
    return b"".join((head, least.astype("<u4").tobytes(), widths.tobytes(), out.sum(axis=1).astype(np.uint8).tobytes(),
                     starts.astype("<u4").tobytes(), area.tobytes(), places.astype(np.uint8).tobytes(),
                     values.tobytes()))


def unpack(payload: bytes, block: int | None = None) -> np.ndarray:
    """All ids of a payload as little-endian u32, or those of one block."""
    mark, n, blocks = struct.unpack_from("<IQI", payload)
    if mark != MARK:
        raise ValueError("not a payload of token ids")
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(payload, kind, count, at)
        at += got.nbytes
        return got

    least, widths, outliers = take("<u4", blocks), take("u1", blocks), take("u1", blocks)
    starts = take("<u4", blocks).astype(np.int64)
    area = take("<u8", int(2 * widths.astype(np.int64).sum()))
    count = int(outliers.sum(dtype=np.int64))
    places, values = take("u1", count), take("<u4", count)
    chosen = np.arange(blocks) if block is None else np.array([block])
    rows = np.zeros((len(chosen), BLOCK), np.uint64)
    for width in np.unique(widths[chosen]).tolist():
        if not width:
            continue
        own = np.nonzero(widths[chosen] == width)[0]
        packed = np.ascontiguousarray(area[starts[chosen[own]][:, None] + np.arange(2 * width)].T)
        columns = np.empty((BLOCK, len(own)), np.uint64)
        mask = _SHIFTS[width] - np.uint64(1)
        for i in range(BLOCK):
            word, shift = divmod(i * width, 64)
            bits = packed[word] >> np.uint64(shift)
            if shift + width > 64:
                bits = bits | (packed[word + 1] << np.uint64(64 - shift))
            columns[i] = bits & mask
        rows[own] = columns.T
    owner = np.repeat(np.arange(blocks), outliers)
    if block is not None:
        mine = owner == block
        owner, places, values = np.zeros(int(mine.sum()), np.int64), places[mine], values[mine]
    rows[owner, places] = values
    ids = (rows + least[chosen].astype(np.uint64)[:, None]).astype("<u4").ravel()
    return ids[:n] if block is None else ids[:max(0, min(BLOCK, n - block * BLOCK))]


class Encoder:
    """Ids of texts from a tokenizer of the ``tokenizers`` library, as bytes.

    Texts are cut at ASCII white space, which this tokenizer drops, and each
    distinct piece is encoded by the library once. Letters that its normalizer
    leaves alone go to its model directly, any punctuation after them apart, as
    its splitting would have it; all other pieces pass the whole tokenizer. That
    holds for tokenizers that lower-case, split at white space and between
    letters and punctuation, and map bytes to letters.
    """

    def __init__(self, tokenizer_json: str):
        self.json = tokenizer_json

    def __getstate__(self):
        return {"json": self.json}

    def open(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = self.tokenizer.model.tokenize
        self.letters = {b: x for x, b in byte_letters().items()}
        self.known = Memo(self.piece, _KEEP, LONGEST)
        self.tails = Memo(self.whole, 10_000, LONGEST)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def model(self, letters: str) -> bytes:
        return array("I", [x.id for x in self.split(letters)]).tobytes()

    def piece(self, piece: bytes) -> bytes:
        # ASCII letters stand for themselves in the model.
        if found := _ASCII.fullmatch(piece):
            core, tail = found.groups()
            return self.known[core] + self.tails[tail.decode()] if tail else self.model(core.decode())
        text = piece.decode()
        found = _LETTERS.fullmatch(text)
        if found is None:
            return self.whole(text)
        core, tail = found.groups()
        if tail:
            return self.known[core.encode()] + self.tails[tail]
        return self.model(piece.decode("latin-1").translate(self.letters))

    def encode(self, text: bytes) -> bytes:
        """The ids of a text as little-endian u32; a few MB of it are cut at a time."""
        if not hasattr(self, "known"):
            self.open()
        # Added tokens are matched before lower-casing, so their case counts.
        text = text if b"<|" in text else text.lower()
        return b"".join([b"".join(map(self.known.__getitem__, part.split())) for part in parts(text)])


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = None) -> None:
    """Writes the ids of (doc_id, text) in ascending doc_id order; one shuffle, of the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(Path(tokenizer).read_text()))
    end = b"" if end_id is None else struct.pack("<I", end_id)
    key = docs.schema["doc_id"].dataType
    kind = pa.int64() if key.simpleString() == "bigint" else None

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = shared.value, TaskContext.get().partitionId()
        seq = before = held = 0
        keys, runs = [], []

        def segment() -> pa.RecordBatch:
            nonlocal seq, before, held
            ids = np.frombuffer(b"".join(runs), "<u4")
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([len(ids)], pa.int64()),
                 pa.array([keys], pa.list_(kind) if kind else None),
                 pa.array([[len(x) // 4 for x in runs]], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary())],
                ["part", "seq", "before", "n_ids", "doc_ids", "lengths", "payload"])
            seq, before, held = seq + 1, before + len(ids), 0
            keys.clear()
            runs.clear()
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.large_binary())):
                run = encoder.encode(text.as_py() or b"") + end
                keys.append(doc_id.as_py())
                runs.append(run)
                held += len(run) // 4
                if held >= SEGMENT:
                    yield segment()
        if keys:
            yield segment()

    schema = StructType.fromDDL("part int, seq int, before long, n_ids long")
    schema = StructType([*schema.fields, StructField("doc_ids", ArrayType(key)),
                         *StructType.fromDDL("lengths array<long>, payload binary").fields])
    (docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
     .mapInArrow(segments, schema).write.parquet(path))
    shared.destroy()


def runs_of(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ids that end at ``ends``, as bytes. Arrow keeps for good what it makes an array of as memoryviews."""
    offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian u32 bytes, start counted over all files.

    The index has a row per writing task, 16 bytes each, so a million tasks
    make 16 MB: it is broadcast. Its columns alone are read for it.
    """
    rows = spark.read.parquet(path)
    key = rows.schema["doc_ids"].dataType.elementType
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    index = (rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")))
    placed = (rows.join(F.broadcast(index), "part")
              .select((F.col("offset") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload"))
    schema = StructType([StructField("doc_id", key),
                         *StructType.fromDDL("start long, n_tokens long, ids binary").fields])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = unpack(row.column("payload")[0].as_buffer())
                lengths = np.array(row.column("lengths")[0].as_py(), np.int64)
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids")[0].values, pa.array(row.column("start")[0].as_py() + ends - lengths),
                     pa.array(lengths), runs_of(ids, ends)], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(documents, schema)
