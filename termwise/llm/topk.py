"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets, each cut into blocks of at most
``BLOCK`` vectors, so no bucket is one task however many vectors share a length.
Every query first meets the longest vectors; its k-th best product so far is its
threshold ``t``. A bucket is then given only queries with ``t <= |q| * longest``.
Against one bucket a query's local cosine threshold is ``t / (|q| * longest)``:
where it is high, candidates are kept by coordinate pruning (the part of the
product outside a few strong coordinates is at most the product of the lengths
left over); where it is low, by length alone. What remains is verified by exact
integer products.

Blocks of vectors and of queries meet in cells, a square of at most ``CELL``
bytes a side: a cell has its blocks once each and keeps k rows a query. Both
sides come by a shuffle on the cell's number; nothing is broadcast, so what the
driver holds grows with neither.

Bounds are widened by a little more than rounding can cost and equal scores are
never pruned, so ties are decided by the smaller id, over all vectors.

A component ``x`` counts as ``floor(256 * x)``. Vectors that are null, or hold a
null or a component that is not finite, take no part; neither do those whose id
is null. Shorter vectors count as filled up with zeros. Rows that repeat an id
are candidates each, and queries once; a query never meets rows of its own id.
Products are exact up to 2**53; where components could pass that, whole numbers
without bound are used, and a score outside of 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termwise.llm.texts import written

SCALE, BLOCK, QUERIES, BUCKETS, FOCUS, FIRST = 256, 1024, 1024, 32, 4, 2
HIGH = 0.6
# Bytes of doubles to a side of a cell, and cells to make at least where there are blocks enough.
CELL, CELLS = 1 << 25, 64
# Vectors that a block of queries meets at once, and products of a step.
TILE, STEP = 4096, 1 << 20
_EXACT, _EXACT_FLOAT = float(1 << 53), float(1 << 24)


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, norm) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    # floor() gives 64 bits; larger numbers are whole already.
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 2.0**52, F.floor(
        x.cast("double") * SCALE).cast("double")).otherwise(x.cast("double") * SCALE))
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
        .select("vec_id", whole.alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    )


def _matrix(rows: pa.Table, width: int) -> np.ndarray:
    matrix = np.zeros((rows.num_rows, width))
    column = rows.column("v").combine_chunks()
    at = np.arange(width)[None, :] < np.diff(column.offsets.to_numpy())[:, None]
    matrix[at] = column.flatten().to_numpy()
    return matrix


def _pack(width: int, kind: str):
    """Rows of one block as one row: ids and a matrix of ``width`` columns of type ``kind``."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({
            "block": pa.array([key[0].as_py()], pa.int64()),
            "ids": pa.array([rows.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "data": pa.array([_matrix(rows, width).astype(kind).tobytes()], pa.binary()),
        })

    return run


_PACKED = "block long, ids binary, data binary"


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of two matrices of whole numbers; those of single precision must be known to fit it."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if q.dtype == np.float32 or np.abs(q).max() * np.abs(c).max() * q.shape[1] < _EXACT:
        return q @ c.T
    exact = [[[int(x) for x in row] for row in m] for m in (q, c)]
    return np.array([[sum(a * b for a, b in zip(x, y)) for y in exact[1]] for x in exact[0]], np.int64)


def best_of(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, least: np.ndarray,
            k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate ids, scores): the k best of a block that reach ``least``.

    ``c`` is in the order of falling length. ``least`` is minus infinity for a
    query without a threshold.
    """
    q_norm, c_norm = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    slack = 1e-9 * (q_norm * (c_norm[0] if len(c) else 0.0)) + 1e-6
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_norm > 0, (least - slack) / (q_norm * max(c_norm[0], 1e-300)), -np.inf)
    coordinate = np.nonzero((local > HIGH) & (local <= 1))[0]
    # Zero queries score 0 against all and cannot be pruned.
    by_length = np.nonzero((local <= HIGH) | (q_norm == 0))[0]
    # No sum on the way passes the product of the lengths, so single precision is exact below 2**24.
    fits = len(q) and len(c) and q_norm.max() * c_norm.max() < 0.999 * _EXACT_FLOAT
    q_set, c_set = (q.astype(np.float32), c.astype(np.float32)) if fits else (q, c)
    many = max(1, STEP // max(1, len(c)))
    for at in range(0, len(by_length), many):
        rows = by_length[at:at + many]
        # A candidate reaches a threshold only if |q| * |c| does: a prefix in the order of length.
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(q_norm[rows] > 0, (least[rows] - slack[rows]) / q_norm[rows], -np.inf).min()
        size = int(np.searchsorted(-c_norm, -need, side="right")) if need > 0 else len(c)
        scores = _products(q_set[rows], c_set[:size])
        # Rounded to the scores' precision a threshold may let more through, which _top sorts out.
        bound = least[rows].astype(np.float32) if scores.dtype == np.float32 else least[rows]
        hit = np.flatnonzero(scores >= bound[:, None])
        ends = np.searchsorted(hit, np.arange(len(rows) + 1) * size)
        scores, ids = scores.ravel()[hit], c_ids[hit % max(1, size)]
        for i in np.nonzero(np.diff(ends))[0]:
            some = slice(ends[i], ends[i + 1])
            yield from _top(rows[i], scores[some], ids[some], q_ids[rows[i]], least[rows[i]], k)
    across, squares = np.ascontiguousarray(c.T) if len(coordinate) else c.T, c_norm**2
    for row in coordinate:
        focus = np.argsort(-np.abs(q[row]))[:FOCUS]
        part = across[focus]
        rest_q = np.sqrt(max(0.0, q_norm[row] ** 2 - (q[row][focus] ** 2).sum()))
        rest_c = np.sqrt(np.maximum(0.0, squares - (part * part).sum(0)))
        able = np.nonzero(q[row][focus] @ part + rest_q * rest_c >= least[row] - slack[row])[0]
        yield from _top(row, _products(q_set[row:row + 1], c_set[able])[0], c_ids[able], q_ids[row], least[row], k)


def _top(row: int, scores: np.ndarray, ids: np.ndarray, own: int, least: float, k: int):
    keep = np.nonzero((ids != own) & (scores >= least))[0]
    if len(keep) > k:
        # All that tie with the k-th stay until ids decide.
        kth = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= kth]
        keep = keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    if len(keep):
        yield row, ids[keep], scores[keep].astype(np.int64)


def _search(k: int, width: int, kind: str):
    """The k best of a cell for each of its queries, whose thresholds rise from tile to tile."""

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        def side(rows: pa.Table, r: int, ids: str, data: str) -> tuple[np.ndarray, np.ndarray]:
            matrix = np.frombuffer(rows.column(data)[r].as_buffer(), kind).reshape(-1, width)
            return np.frombuffer(rows.column(ids)[r].as_buffer(), "<i8"), matrix.astype(np.float64)

        met = [side(blocks, r, "ids", "data") for r in range(blocks.num_rows)]
        c_ids, c = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros((0, width))), *met))
        # The longest vectors first.
        order = np.argsort(-(c * c).sum(1))
        met = [(c_ids[x], c[x]) for x in (order[at:at + TILE] for at in range(0, len(order), TILE))]
        out = [(np.zeros(0, np.int64),) * 3]
        for r in range(asked.num_rows):
            q_ids, q = side(asked, r, "q_ids", "q_data")
            least = np.frombuffer(asked.column("q_least")[r].as_buffer()).copy()
            best = {}
            for c_ids, c in met:
                for row, ids, scores in best_of(q, q_ids, c, c_ids, least, k):
                    if row in best:
                        ids, scores = (np.concatenate(x) for x in zip(best[row], (ids, scores)))
                        keep = np.lexsort((ids, -scores))[:k]
                        ids, scores = ids[keep], scores[keep]
                    best[row] = ids, scores
                    if len(ids) == k:
                        least[row] = max(least[row], scores.min())
            if best:
                found = [*best.values()]
                out.append((np.repeat(q_ids[[*best]], [len(x) for x, _ in found]),
                            *(np.concatenate(x) for x in zip(*found))))
        return pa.table(dict(zip(["query_id", "vec_id", "score"], (np.concatenate(x) for x in zip(*out)))))

    return run


def _queries(width: int, kind: str):
    """Query rows of a block, with what each must reach, as one row."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        matrix = _matrix(rows, width)
        least = rows.column("least").to_numpy()
        norms = np.sqrt((matrix * matrix).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(norms > 0, least / norms, -np.inf)
        return pa.table({
            "q_block": pa.array([key[0].as_py()], pa.int64()),
            "q_ids": pa.array([rows.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "q_data": pa.array([matrix.astype(kind).tobytes()], pa.binary()),
            "q_least": pa.array([least.astype("<f8").tobytes()], pa.binary()),
            "reach": pa.array([float(reach.min())], pa.float64()),
        })

    return run


_Q_PACKED = "q_block long, q_ids binary, q_data binary, q_least binary, reach double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _facts(rows: DataFrame) -> tuple[int, int, float]:
    """Longest vector, number of rows, greatest component."""
    peak = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    found = rows.agg(F.max(F.size("v")), F.count(F.lit(1)), peak).first()
    return found[0] or 0, found[1], found[2] or 0.0


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``.

    Both hold vec_id and embedding. Each block of queries meets each block of
    vectors that its thresholds leave, in the cell of both. The driver sees one
    row per bucket.
    """
    base = written(scaled(vectors), "vectors")
    # Of a repeated id's vectors, one by a fixed order; written, so that both passes ask for the same.
    given = scaled(queries)
    rest = [x for x in given.columns if x not in ("vec_id", "v")]
    asked = written(
        given.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("v").alias("_h"), "v", *rest)).alias("_row"))
        .select("vec_id", "_row.v", *(f"_row.{x}" for x in rest)), "asked")
    (width, n, peak), (q_width, q_n, q_peak) = _facts(base), _facts(asked)
    width, peak = max(1, width, q_width), max(peak, q_peak)
    # Components are whole numbers; they travel in the least type that holds all.
    kind = next((x for x, top in (("<i1", 2**7), ("<i2", 2**15), ("<i4", 2**31)) if peak < top), "<f8")
    # Bounds at about even shares; any bounds are right, these keep lengths in a bucket alike.
    cuts = sorted(set(base.approxQuantile("norm", [i / BUCKETS for i in range(1, BUCKETS)], 0.005))) if n else []
    bucket = sum((F.when(F.col("norm") > x, 1).otherwise(0) for x in cuts), F.lit(0))
    sized = base.withColumn("bucket", bucket)
    buckets = {r["bucket"]: (r["longest"], -(-r["n"] // BLOCK)) for r in
               sized.groupBy("bucket").agg(F.max("norm").alias("longest"), F.count(F.lit(1)).alias("n")).collect()}
    starts, total = {}, 0
    for b in sorted(buckets, reverse=True):
        starts[b] = total
        total += buckets[b][1]

    def of_bucket(value) -> Column:
        pairs = [x for b in buckets for x in (F.lit(b), F.lit(value(b)))] or [F.lit(0), F.lit(0)]
        return F.element_at(F.create_map(*pairs), F.col("bucket"))

    blocks = written(
        sized.withColumn("block", of_bucket(lambda b: starts[b]) + F.pmod(
            F.xxhash64("vec_id", "v"), of_bucket(lambda b: buckets[b][1])))
        .groupBy("block").applyInArrow(_pack(width, kind), _PACKED), "blocks")
    # A block lies in one bucket; runs of blocks with the greatest length in each, longest first.
    runs = [(starts[b], starts[b] + buckets[b][1] - 1, buckets[b][0]) for b in sorted(buckets, reverse=True)]
    q_blocks = max(1, -(-q_n // QUERIES))
    q_block = F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks))

    # Stripes and groups as large as a cell's sides may be; smaller ones where that leaves few cells.
    most, q_most = (max(1, CELL // (8 * width * x)) for x in (BLOCK, QUERIES))
    step = max(1, min(most, total // CELLS))

    def meet(rows: DataFrame, first: int, last: int) -> DataFrame:
        """Stripes of the blocks from ``first`` to ``last`` and groups of blocks of queries meet in a cell a pair."""
        groups = max(-(-q_blocks // q_most), min(q_blocks, -(-CELLS // max(1, -(-(last - first + 1) // step)))))
        packed = rows.withColumn("q_block", q_block.cast("long")).groupBy("q_block").applyInArrow(
            _queries(width, kind), _Q_PACKED)
        chosen = [(max(lo, first) - first, min(hi, last) - first, x) for lo, hi, x in runs if lo <= last and hi >= first]
        spans = [F.when(F.col("reach") <= longest * (1 + 1e-9) + 1e-6, F.sequence(F.lit(lo // step), F.lit(hi // step)))
                 .otherwise(F.array().cast("array<int>")) for lo, hi, longest in chosen]
        spans = F.array_distinct(F.flatten(F.array(*spans))) if spans else F.array().cast("array<int>")
        left = (packed.withColumn("stripe", F.explode(spans.cast("array<bigint>")))
                .select((F.col("stripe") * groups + F.col("q_block") % groups).alias("cell"),
                        "q_ids", "q_data", "q_least"))
        right = (blocks.filter(F.col("block").between(first, last))
                 .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
                 .select((F.floor((F.col("block") - first) / step) * groups + F.col("group")).alias("cell"),
                         "ids", "data"))
        return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(
            _search(k, width, kind), "query_id long, vec_id long, score long")

    # The first blocks hold the longest vectors and give the thresholds.
    first = max(FIRST, total // 16)
    seen = written(_ranked(meet(asked.withColumn("least", F.lit(float("-inf"))), 0, first - 1), k).drop("rank"), "seen")
    floor = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"), F.min("score").alias("kth"))
    known = asked.join(floor.hint("merge"), asked["vec_id"] == floor["query_id"], "left").select(
        "vec_id", "v", F.when(F.col("have") >= k, F.col("kth").cast("double")).otherwise(float("-inf")).alias("least"))
    later = meet(known, first, total - 1)
    return _ranked(seen.unionByName(later), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
