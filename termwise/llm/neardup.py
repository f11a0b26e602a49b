"""Near-duplicates by MinHash bands, odd sketches and exact confirmation.

A document's set holds its distinct ``width``-word shingles, as 64-bit hashes.
Equal sets are one class; the search runs on classes, so copies cost nothing
beyond their own row. Per class there are ``BANDS * ROWS`` MinHash samples: the
bands name candidates, and an odd sketch, the parity of the samples' hashes in
``BITS`` bits, tells by the ones in the XOR of two sketches how many samples
differ. Candidates whose sketches are further apart than any pair over the
threshold can plausibly be are dropped; all others are compared set by set.

1. Stars: in each bucket of a band every class is paired with one leader.
2. Components of the confirmed links.
3. Rest: in buckets that still hold several components, classes of different
   components are compared by sketch, then by their sets, in chunks of bounded
   size, so that links which no leader showed are found too. Only links that join
   components not joined before go out, fewer than a chunk has classes.
4. Components of all links; a document's is named by its smallest id.

A pair at the threshold misses all bands once in some ten million cases, and
the sketch bound is as wide. Nothing else is left out: no bucket has a cap.

Null or empty texts, or texts without a word: an empty set, linked with nothing;
their component is their own id. Fewer words than ``width``: the whole sequence
is one shingle. A null id: never linked, component null, kept. Rows that repeat
an id and text are in one class and share the verdict; a repeated id with other
texts is judged by each text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwise.llm.components import components
from termwise.llm.texts import Memo, as_bytes, packed, parts, with_arrays, written

BANDS, ROWS, BITS, CHUNK = 40, 5, 512, 2048
SAMPLES = BANDS * ROWS
_WORDS = 200_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BY = [np.uint64(x) for x in (31, 27, 30)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _BY[2])) * _MIX[1]
    x = (x ^ (x >> _BY[1])) * _MIX[2]
    return x ^ (x >> _BY[0])


_A = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _MIX[0]) | np.uint64(1)
_B = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _MIX[1])

_hashes = Memo(xxhash.xxh64_intdigest, _WORDS, 64)


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    runs = []
    for part in parts(text.lower()):
        words = part.split()
        runs.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
    words = np.concatenate(runs)
    if not len(words):
        return words
    size = min(width, len(words))
    count = len(words) - size + 1
    out = np.full(count, size, np.uint64)
    for i in range(size):
        out = mixed(out * _MIX[0] + words[i:i + count])
    return np.unique(out)


def samples(found: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that is not empty."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        np.minimum(least, (found[i:i + 512, None] * _A + _B).min(axis=0), out=least)
    return least


def odd_sketch(drawn: np.ndarray) -> np.ndarray:
    """Parities of the samples of each row, folded into ``BITS`` bits, as u64 words."""
    places = (mixed(drawn + _B) >> np.uint64(32)) % np.uint64(BITS)
    flat = places.astype(np.int64) + np.arange(len(drawn))[:, None] * BITS
    parity = (np.bincount(flat.ravel(), minlength=len(drawn) * BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(-1, BITS), axis=1).view("<u8")


def most_ones(percent: int) -> int:
    """Ones in the XOR of two sketches that a pair at the threshold passes once in millions.

    Of the samples about ``1 - percent`` differ; each differing sample is two
    elements of the symmetric difference, and ``d`` elements set about
    ``BITS / 2 * (1 - exp(-2 d / BITS))`` bits.
    """
    share = 1 - percent / 100
    differ = min(SAMPLES, SAMPLES * share + 5.2 * math.sqrt(SAMPLES * share * (1 - share)) + 1)
    ones = BITS / 2 * (1 - math.exp(-4 * differ / BITS))
    return min(BITS, math.ceil(ones + 2 * math.sqrt(BITS) / 2))


_SIGNED = "n_shingles long, _node long, _bands array<long>, _sketch array<long>"


def _sign(width: int):
    def run(texts: pa.Array) -> list[pa.Array]:
        n, nodes, drawn = [], [], []
        for text in as_bytes(texts):
            found = shingles(text, width)
            n.append(len(found))
            nodes.append(_node(found))
            drawn.append(samples(found) if len(found) else np.zeros(SAMPLES, np.uint64))
        drawn = np.array(drawn, np.uint64).reshape(-1, SAMPLES)
        names = np.zeros((len(drawn), BANDS), np.uint64)
        for i in range(ROWS):
            names = mixed(names * _MIX[0] + drawn[:, i::ROWS])
        sketches = odd_sketch(drawn)

        def lists(matrix: np.ndarray) -> pa.Array:
            offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.astype("<u8").view("<i8").ravel()))

        return [pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), lists(names), lists(sketches)]

    return run


def _apart(a: str, b: str):
    """Ones in the XOR of two sketches, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _alike(small: str, great: str, percent: int):
    """Sizes that allow the threshold at all."""
    return F.expr(f"100 * least({small}, {great}) >= {percent} * greatest({small}, {great})")


def _by_sketch(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose sizes and sketches allow the threshold."""
    for side in "ab":
        facts = classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"),
                               F.col("sketch").alias(f"s_{side}"))
        pairs = pairs.join(facts, side)
    return pairs.filter(_alike("n_a", "n_b", percent) & (_apart("s_a", "s_b") <= most_ones(percent))).select("a", "b")


def _pairs_of(group: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links of one group that join its components as far as its sets are alike: at most one fewer than its rows.

    A group is one chunk of a bucket, or two whose rows meet each other only. Pairs
    are told apart by size and sketch and confirmed on their whole sets; a pair that
    earlier links of the group have joined needs no look.
    """
    sizes = group.column("n").to_numpy()
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    nodes, comps, chunks = (group.column(x).to_numpy()[order] for x in ("node", "comp", "chunk"))
    comps = comps.copy()
    sketches = group.column("sketch").combine_chunks().flatten().to_numpy().view("<u8").reshape(len(nodes), -1)[order]
    whole = group.column("whole").combine_chunks()
    starts, values = whole.offsets.to_numpy(), whole.values.to_numpy()
    within = group.column("low")[0].as_py() == group.column("high")[0].as_py()
    limit, found = most_ones(percent), ([], [])

    def members(i: int) -> np.ndarray:
        return values[starts[order[i]]:starts[order[i] + 1]]

    # In the order of size, only a stretch can be alike.
    ends = np.searchsorted(sizes * percent, 100 * sizes, side="right")
    for i in range(len(nodes) - 1):
        span = slice(i + 1, ends[i])
        near = comps[span] != comps[i]
        if not within:
            near &= chunks[span] != chunks[i]
        if near.any():
            near &= np.bitwise_count(sketches[span] ^ sketches[i]).sum(axis=1) <= limit
            for j in (np.nonzero(near)[0] + i + 1).tolist():
                if comps[j] != comps[i] and _alike_sets(members(i), members(j), percent):
                    found[0].append(min(nodes[i], nodes[j]))
                    found[1].append(max(nodes[i], nodes[j]))
                    comps[comps == comps[j]] = comps[i]
    return found


def _alike_sets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _cross(percent: int):
    """``_pairs_of`` over rows sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            if not rows.num_rows:
                continue
            keys = np.stack([rows.column(x).to_numpy() for x in _GROUP])
            starts = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist()]
            for lo, hi in zip(starts, starts[1:]):
                yield rows_of(rows.slice(lo, hi - lo))
            held = rows.slice(starts[-1])
        if held is not None:
            yield rows_of(held)

    def rows_of(group: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _pairs_of(group, percent)], ["a", "b"])

    return run


_GROUP = ["band", "name", "low", "high"]


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, whole): the set of each node."""
    ids = classes.join(nodes, "node").select(F.col("rep").alias("doc_id")).distinct()

    def sets(texts: pa.Array) -> list[pa.Array]:
        found = [shingles(x, width) for x in as_bytes(texts)]
        values = np.concatenate([*found, np.array([], np.uint64)]).view("<i8")
        offsets = np.cumsum([0, *map(len, found)])
        return [pa.array([_node(x) for x in found], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))]

    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    # A repeated id may bring other texts and repeated rows; each wanted set is needed once.
    return written(
        with_arrays(texts, "node long, whole array<long>", sets, [])
        .join(nodes, "node", "left_semi").groupBy("node").agg(F.first("whole").alias("whole")), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose whole sets are alike enough."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("whole").alias(f"w_{side}")), side)
    both = F.size(F.array_intersect("w_a", "w_b"))
    return (pairs.withColumn("_both", both)
            .filter(F.expr(f"100 * _both >= {percent} * (size(w_a) + size(w_b) - _both)")).select("a", "b"))


def _node(found: np.ndarray) -> int | None:
    """What names a set; equal sets have equal names."""
    return xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63) if len(found) else None


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, keep: list[str] | None = None,
                    root: bool = False) -> DataFrame:
    """``docs`` with n_shingles, component_id and kept (``doc_id = component_id``).

    ``docs`` is read twice; ``keep`` names its columns to return, by default all.
    Columns of ``docs`` that bear an added name are replaced; any others stay.
    ``root`` adds component_root, which tells components apart where one id
    stands for unlike texts; it is NULL for rows without an id or without a word.
    """
    docs, unpack = packed(docs.drop("n_shingles", "component_id", "kept", "component_root"), ["doc_id", "text"], keep)
    signed = written(with_arrays(docs, _SIGNED, _sign(width), [x for x in docs.columns if x != "text" or keep is None or x in keep]), "signed")
    classes = written(
        signed.filter("_node IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("_node").alias("node"))
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("_bands").alias("bands"),
             F.first("_sketch").alias("sketch")), "classes")
    # Buckets of one class have nothing to compare.
    named = classes.select("node", F.posexplode("bands").alias("band", "name"))
    buckets = written(named.groupBy("band", "name").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead"))
                      .filter("size > 1"), "buckets")
    members = written(named.join(buckets, ["band", "name"]), "members")
    stars = written(_by_sketch(members.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
                               .distinct(), classes, percent), "stars")
    ends = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    links = written(_confirmed(stars, _sets(ends, classes, docs, width), percent), "links")
    roots = components(links)
    placed = written(members.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"),
                     "placed")
    several = (placed.groupBy("band", "name").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
               .filter("_lo <> _hi").select("band", "name"))
    chunks = F.ceil(F.col("size") / CHUNK)
    open_ = written(placed.join(several, ["band", "name"], "left_semi"), "open")
    full = _sets(open_.select("node").distinct(), classes, docs, width)
    facts = classes.select("node", "n", "sketch").join(full, "node")
    more = written(
        open_.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        .withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
        .join(facts, "node").select(*_GROUP, "chunk", "node", "comp", "n", "sketch", "whole")
        .repartition(*_GROUP).sortWithinPartitions(*_GROUP)
        .mapInArrow(_cross(percent), "a long, b long").distinct(), "more")
    roots = components(links.unionByName(more))
    reps = classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = reps.groupBy("root").agg(F.min("rep").alias("_first"))
    found = written(reps.join(firsts, "root").select(F.col("node").alias("_node"), "_first", F.col("root").alias("_root")), "found")
    judged = (
        signed.drop("_bands", "_sketch").join(found, "_node", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_first", "doc_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .withColumn("component_root", F.when(F.col("doc_id").isNotNull(), F.col("_root")))
    )
    return unpack(judged, "n_shingles", "component_id", "kept", *(["component_root"] if root else []))
