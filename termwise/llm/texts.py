"""What the corpus jobs share: words as bytes, Arrow columns, scratch tables.

A word is ``[^\\x20\\x09-\\x0D]+``. ``bytes.split()`` cuts at exactly those six
bytes, so words are handled as UTF-8 bytes throughout.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termwise.session import scratch_path

_SLICE = 512
_BREAK = re.compile(rb"[ \t-\r]")

WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod, F.lit(0))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, a null as no bytes."""
    wide = pa.types.is_large_string(column.type)
    return [x or b"" for x in column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()]


def parts(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """A text in consecutive pieces of about ``size`` bytes, cut before white space."""
    at = 0
    while len(text) - at > size and (found := _BREAK.search(text, at + size)):
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder, which cuts its lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, apart: list[str], keep: list[str] | None = None):
    """``docs`` with the columns ``apart`` and all others in one struct, and what gives them back their names.

    Between the two no other name of ``docs`` can meet one that a job uses. ``keep``
    names the columns to give back, by default all.
    """
    wanted = [x for x in docs.columns if keep is None or x in keep]
    rest = [x for x in wanted if x not in apart]
    own = [F.col(f"`{x}`") for x in docs.columns if x in apart]
    frame = docs.select(*own, F.struct(*[F.col(f"`{x}`") for x in rest]).alias("_rest")) if rest else docs.select(*own)

    def unpack(df: DataFrame, *added: str) -> DataFrame:
        return df.select(*[F.col(x) if x in apart else F.col("_rest").getField(x).alias(x) for x in wanted], *added)

    return frame, unpack


def list_array(values: pa.Array, lengths) -> pa.Array:
    """Consecutive runs of ``values`` as lists."""
    offsets = [0]
    total = 0
    for n in lengths:
        total += n
        offsets.append(total)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def with_arrays(docs: DataFrame, fields: str, compute, keep: list[str] | None = None, reads: str = "text") -> DataFrame:
    """``docs`` with the columns ``fields``, which ``compute`` makes from one column's Arrow array.

    ``keep`` names the columns of ``docs`` to return, by default all. Columns
    of ``docs`` that bear an added name are replaced.
    """
    added = StructType.fromDDL(fields)
    own = [x for x in docs.columns if x not in added.names and (keep is None or x in keep or x == reads)]
    docs = docs.select(*own)
    kept = [x for x in own if keep is None or x in keep]
    schema = StructType([docs.schema[x] for x in kept] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker takes on other work from task to task: tables and caches in cycles that the last task left go first.
        gc.collect()
        for batch in batches:
            # A few hundred rows at a time keep what is made of them small.
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(x) for x in kept), *compute(part.column(reads))], schema.names)

    return docs.mapInArrow(run, schema)


class Memo(dict):
    """Answers of ``work`` by key. Of the answers before the last ``limit``, those asked for again stay.

    Keys longer than ``longest`` are answered and not kept, so that a cache of
    words stays small where a word is a whole text.
    """

    def __init__(self, work, limit: int, longest: int | None = None):
        # Caches often hold their owners in cycles, and a worker outlives its jobs: what earlier ones left goes first.
        gc.collect()
        self._work, self._limit, self._longest, self._old = work, limit, longest, {}

    def __missing__(self, key):
        if self._longest is not None and len(key) > self._longest:
            return self._work(key)
        answer = self._old.get(key)
        if answer is None:
            answer = self._work(key)
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = answer
        return answer
