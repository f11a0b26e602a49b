"""Document fingerprints: MinHash signatures, their likeness, and near-duplicate groups by bands.

A text's set holds its distinct runs of ``width`` words (``[^\\x20\\x09-\\x0D]+``, lower-cased
in A-Z), each folded to 32 bits. ``SAMPLES`` hash functions of the multiply-add family,
which is universal for 32 bits, permute the set; the signature keeps each one's least
value. A fingerprint is the signature's upper halves in hex, its likeness to another the
share of equal samples, which estimates the sets' Jaccard similarity.

``edited`` puts documents in order and gives each the start of the next one for its last
quarter. Texts are dealt by range once and stream through; only the two documents at the
ends of a partition wait for their neighbour in another.

``near_groups`` joins signature bands. Equal sets are one class. In rounds, each bucket
that still holds several groups compares all its classes with a few leaders, signatures
first, then the whole sets; it ends when every bucket is one group or has had each of its
classes as leader. So each pair that shares a band is compared or already joined.

Empty and null texts: no set; likeness 1 to each other, 0 to all others; linked with
nothing. Fewer words than ``width``: the whole sequence is one element. Documents run by
doc_id, nulls first, then by a hash of their text; repeated rows are documents of their
own. One document is its own next. An empty table gives no rows. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwise.llm.components import components
from termwise.llm.texts import Memo, as_bytes, parts, written

SAMPLES, BANDS, WIDTH, PERCENT, LEADERS = 128, 32, 5, 80, 16
ROWS = SAMPLES // BANDS
_MEMO, _KEPT_WORD, _BLOCK = 200_000, 64, 1024


def _drawn(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64)


_A, _B, _FOLD = _drawn(SAMPLES, 1) | np.uint64(1), _drawn(SAMPLES, 2), _drawn(64, 3) | np.uint64(1)
_NONE = np.uint64(np.iinfo(np.uint64).max)


class _Hashes(Memo):
    """Hashes of words; those of long words are not kept."""

    def __missing__(self, word):
        return super().__missing__(word) if len(word) <= _KEPT_WORD else xxhash.xxh64_intdigest(word)


_hashes = _Hashes(xxhash.xxh64_intdigest, _MEMO)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The set of a text: sorted 32-bit numbers, as u64."""
    runs = []
    for part in parts(text.lower()):
        words = part.split()
        runs.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
    words = np.concatenate(runs)
    size = min(width, len(words))
    if not size:
        return words
    count = len(words) - size + 1
    out = np.full(count, size, np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(29)) ^ words[i:i + count]) * _FOLD[i % 64]
    return np.unique(out >> np.uint64(32))


def signature(found: np.ndarray) -> np.ndarray:
    """The least value of each permutation, 32 bits each; all ones for an empty set."""
    least = np.full(SAMPLES, _NONE)
    for i in range(0, len(found), _BLOCK):
        # The least product has the least upper half.
        np.minimum(least, (found[i:i + _BLOCK, None] * _A + _B).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def fingerprint(drawn: np.ndarray) -> bytes:
    return (drawn >> np.uint32(16)).astype("<u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return float(np.mean(np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0


class _Text:
    def __init__(self, doc_id: int | None, text: str | None, width: int):
        self.doc_id, self.text = doc_id, text or ""
        self.set = shingles(self.text.encode(), width)
        self.mark = fingerprint(signature(self.set))

    def beside(self, other: _Text, width: int) -> tuple:
        n = len(self.text)
        edited = _Text(None, self.text[:n - n // 4] + other.text[:n // 4], width)
        return (self.doc_id, n, hashlib.sha256(edited.text.encode()).digest(), self.mark, edited.mark,
                likeness(self.mark, edited.mark), likeness(self.mark, other.mark),
                jaccard(self.set, edited.set), jaccard(self.set, other.set))


_FACTS = [("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "binary"), ("fingerprint", "binary"),
          ("edited_fingerprint", "binary"), ("near_edited", "double"), ("near_next", "double"),
          ("jaccard_edited", "double"), ("jaccard_next", "double")]
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
_HELD = [*_FACTS, ("part", "int"), ("place", "string"), ("text", "string")]


def _ddl(fields) -> str:
    return ", ".join(" ".join(x) for x in fields)


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[t]) for i, (_, t) in enumerate(fields)],
                                      [x for x, _ in fields])


def _along(width: int):
    """Each document of a partition beside the next; its first and last as they are, for other partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def edge(text: _Text, place: str) -> tuple:
            return (text.doc_id, *[None] * (len(_FACTS) - 1), part, place, text.text)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                text = _Text(doc_id.as_py(), text.as_py(), width)
                rows.append(edge(text, "first") if last is None else (*last.beside(text, width), part, None, None))
                last = text
            yield _batch(rows, _HELD)
        if last is not None:
            yield _batch([edge(last, "last")], _HELD)

    return run


def _pairs(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("doc_id", "text", "next"))
            yield _batch([_Text(d, x, width).beside(_Text(None, y, width), width) for d, x, y in zip(*columns)], _FACTS)

    return run


def edited(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: its fingerprint, that of its text with the next one's start for its last quarter, and likenesses.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) with the exact Jaccard
    similarities jaccard_edited and jaccard_next beside the two estimates.
    """
    # Any tie-breaker will do for rows that are equal; it lets them lie in several partitions.
    order = ["doc_id", "_hash", "_tie"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_tie"))
             .repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text"))
    held = written(dealt.mapInArrow(_along(width), _ddl(_HELD)), "fingerprints")
    facts = [x for x, _ in _FACTS]
    # Two documents a partition.
    ends = held.filter("place IS NOT NULL").select("doc_id", "part", "place", "text")
    firsts = ends.filter("place = 'first'")
    follows = firsts.select("part", F.expr("coalesce(lead(part) OVER (ORDER BY part), min(part) OVER ())").alias("_part"))
    heads = firsts.select(F.col("part").alias("_part"), F.col("text").alias("next"))
    across = (ends.filter("place = 'last'").join(follows, "part").join(heads, "_part")
              .select("doc_id", "text", "next").mapInArrow(_pairs(width), _ddl(_FACTS)))
    return held.filter("place IS NULL").select(*facts).unionByName(across).withColumns(
        {x: F.lower(F.hex(x)) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                found = shingles(text, width)
                name = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                rows.append((doc_id, len(found), name, signature(found).view("<i4").tolist()))
            ids, n, names, drawn = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(drawn, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "node", "drawn"])

    return run


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, members) for the classes wanted, which name a document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x, width) for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()),
                 pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "members"])

    texts = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return (texts.mapInArrow(run, "node binary, members array<long>").join(wanted.select("node"), "node", "left_semi")
            .groupBy("node").agg(F.first("members").alias("members")))


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, leaders: int = LEADERS) -> DataFrame:
    """(doc_id, n_shingles, group_id): a row per document with a word and an id.

    group_id is the smallest doc_id reachable over verified links of at least ``percent`` percent.
    """
    signed = written(docs.select("doc_id", "text").mapInArrow(
        _sign(width), "doc_id long, n_shingles long, node binary, drawn array<int>"), "signed")
    classes = written(signed.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("drawn").alias("drawn")), "classes")
    bands = F.array(*(F.xxhash64(F.slice("drawn", i * ROWS + 1, ROWS)) for i in range(BANDS)))
    named = classes.select("node", F.posexplode(bands).alias("band", "name"))
    shared = named.groupBy("band", "name").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    # A class leads its buckets in the turn that a hash gives it.
    members = written(named.join(shared, ["band", "name"]).withColumn("turn", F.xxhash64("node", "band")), "members")
    sets = written(_sets(docs, classes.join(members.select("node").distinct(), "node", "left_semi"), width), "sets")
    links, done = None, None
    agree = F.size(F.filter(F.arrays_zip("drawn_a", "drawn_b"), lambda x: x["drawn_a"] == x["drawn_b"]))
    # A pair at the threshold agrees in fewer samples once in some ten million cases.
    share = percent / 100
    least = int(SAMPLES * share - 5.2 * (SAMPLES * share * (1 - share)) ** 0.5 - 1)
    placed = members.withColumn("comp", F.col("node"))
    while True:
        spread = placed.groupBy("band", "name").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo <> _hi")
        open_ = placed.join(spread.select("band", "name"), ["band", "name"], "left_semi")
        waiting = open_ if done is None else open_.join(done, ["band", "name", "node"], "left_anti")
        first = written(waiting.withColumn("_nth", F.expr("row_number() OVER (PARTITION BY band, name ORDER BY turn, node)"))
                        .filter(F.col("_nth") <= leaders).select("band", "name", "node", "comp"), "leaders")
        if first.isEmpty():
            break
        done = first.drop("comp") if done is None else written(done.unionByName(first.drop("comp")), "done")
        pairs = (open_.select("band", "name", F.col("node").alias("b"), F.col("comp").alias("_cb"))
                 .join(first.select("band", "name", F.col("node").alias("a"), F.col("comp").alias("_ca")), ["band", "name"])
                 .filter("_ca <> _cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        for side in "ab":
            pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"),
                                              F.col("drawn").alias(f"drawn_{side}")), side)
        close = pairs.filter(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)") & (agree >= least)).select("a", "b")
        for side in "ab":
            close = close.join(sets.select(F.col("node").alias(side), F.col("members").alias(f"m_{side}")), side)
        both = F.size(F.array_intersect("m_a", "m_b"))
        found = (close.withColumn("_both", both)
                 .filter(F.expr(f"100 * _both >= {percent} * (size(m_a) + size(m_b) - _both)")).select("a", "b"))
        links = written(found if links is None else links.unionByName(found).distinct(), "links")
        roots = written(components(links), "roots")
        placed = written(members.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), "placed")
    reps = classes.select("node", "rep")
    if links is None:
        grouped = reps.withColumnRenamed("rep", "group_id")
    else:
        reps = reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        grouped = reps.join(reps.groupBy("root").agg(F.min("rep").alias("group_id")), "root").select("node", "group_id")
    return signed.filter("node IS NOT NULL AND doc_id IS NOT NULL").join(grouped, "node").select(
        "doc_id", "n_shingles", "group_id")
