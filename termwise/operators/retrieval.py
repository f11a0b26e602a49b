"""Exact nearest passages by cosine similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: passages per question.
TOP_K = 6
QUERY_BATCH = 4096
CELL_ROWS = 100_000
SIMILARITY_DIGITS = 6
# More than a product of unit vectors can lose to rounding.
SLACK = 1e-12


def _nearest(k: int):
    """Shared task code: the ``k`` best items per query, ties broken by item id."""

    def unit(vectors) -> np.ndarray:
        matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(norms == 0, 1.0, norms)

    def best(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["q", "similarity", "item_id"], ascending=[True, False, True], kind="stable")
        return found[found.groupby("q", sort=False).cumcount() < k]

    def scan(queries: np.ndarray, ids: np.ndarray, items: np.ndarray, step: int = 1024) -> pd.DataFrame:
        kept = None
        for at in range(0, len(ids), step):
            vectors, block = items[at:at + step], ids[at:at + step]
            close = queries @ vectors.T
            if len(block) > k:
                # Everything that may tie with the k-th best stays in.
                floor = np.partition(close, len(block) - k, axis=1)[:, len(block) - k]
                q, i = np.nonzero(close >= floor[:, None] - SLACK)
            else:
                q, i = np.nonzero(np.ones_like(close, dtype=bool))
            # Summed pair by pair, so equal vectors come out equal wherever they lie.
            part = pd.DataFrame({"q": q, "item_id": block[i], "similarity": (queries[q] * vectors[i]).sum(axis=1)})
            kept = best(part if kept is None else pd.concat([kept, part], ignore_index=True))
        return kept

    def named(found: pd.DataFrame, names: list) -> pd.DataFrame:
        # Plain objects, whatever the id type: the result schema gives the type.
        return pd.DataFrame({
            "query_id": pd.Series([names[q] for q in found["q"]], dtype=object),
            "item_id": pd.Series(found["item_id"].tolist(), dtype=object),
            "similarity": found["similarity"].to_numpy(),
        })

    return unit, best, scan, named


def _finish(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("item_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # Ranked in full, rounded only to be shown.
    return ranked.withColumn("similarity", F.round("similarity", SIMILARITY_DIGITS) + F.lit(0.0))


def retrieve_topk(items: DataFrame, queries: DataFrame, k: int = TOP_K, query_batch: int = QUERY_BATCH,
                  cell_rows: int = CELL_ROWS) -> DataFrame:
    """For each query the ``k`` most similar items, or all of them if fewer exist.

    ``items`` is ``(item_id, embedding)`` and ``queries`` is ``(query_id, embedding)``.
    A batch of at most ``query_batch`` queries is sent to the items, which then
    never move: each task returns its own best ``k`` per query. A larger batch is
    laid out on a grid of cells, every item meeting every block of queries in
    exactly one cell; ids are hashed, so cells are even and bounded. Both are exact.
    """
    item_type = items.schema["item_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, item_id {item_type}, similarity double"
    unit, best, scan, named = _nearest(k)
    items = items.select("item_id", "embedding").filter(F.col("embedding").isNotNull())
    queries = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())

    batch = queries.limit(query_batch + 1).collect()
    if not batch:
        return items.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    if len(batch) <= query_batch:
        sent = items.sparkSession.sparkContext.broadcast(
            ([r["query_id"] for r in batch], unit([r["embedding"] for r in batch])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, vectors = sent.value
            kept = None
            for pdf in batches:
                if len(pdf):
                    part = scan(vectors, pdf["item_id"].to_numpy(), unit(pdf["embedding"]))
                    kept = best(part if kept is None else pd.concat([kept, part], ignore_index=True))
            if kept is not None:
                yield named(kept, names)

        return _finish(items.mapInPandas(run, schema), k)

    item_cells = max(1, math.ceil(items.count() / cell_rows))
    query_cells = max(1, math.ceil(queries.count() / query_batch))
    left = items.withColumn("_i", F.pmod(F.xxhash64("item_id"), F.lit(item_cells))).withColumn(
        "_q", F.expr(f"explode(sequence(0L, {query_cells - 1}L))"))
    right = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(query_cells))).withColumn(
        "_i", F.expr(f"explode(sequence(0L, {item_cells - 1}L))"))

    def cell(item_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(item_rows) or not len(query_rows):
            return named(pd.DataFrame({"q": [], "item_id": [], "similarity": []}), [])
        found = scan(unit(query_rows["embedding"]), item_rows["item_id"].to_numpy(), unit(item_rows["embedding"]))
        return named(found, query_rows["query_id"].tolist())

    met = left.groupBy("_i", "_q").cogroup(right.groupBy("_i", "_q")).applyInPandas(cell, schema)
    return _finish(met, k)


# Rows that fit the centroids, at most; every row is indexed.
FIT_ROWS = 20_000
# For vectors that lie in no groups, as the supplied ones: these find 0.96 of the nearest. Vectors in
# groups need fewer probes; measure with `recall`.
LISTS, PROBES, ROUNDS = 32, 24, 8


def _unit_rows(vectors) -> np.ndarray:
    matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def fit_centroids(items: DataFrame, lists: int = LISTS, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Unit centroids of at most ``lists`` groups, from the ``fit_rows`` items of least hash."""
    sample = items.filter("embedding IS NOT NULL").orderBy(F.xxhash64("item_id"), "item_id").limit(fit_rows).collect()
    if not sample:
        return np.zeros((0, 0))
    points = _unit_rows([r["embedding"] for r in sample])
    # Far apart to begin with: each next centre is the point least like those chosen.
    chosen, close = [0], points @ points[0]
    while len(chosen) < min(lists, len(points)):
        chosen.append(int(close.argmin()))
        close = np.maximum(close, points @ points[chosen[-1]])
    centres = points[chosen]
    for _ in range(ROUNDS):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centres)
    return centres


def inverted_lists(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """(list, item_id, embedding): every item with a vector, in the list of its nearest centroid."""
    sent = items.sparkSession.sparkContext.broadcast(centres)
    item_type = items.schema["item_id"].dataType.simpleString()
    vector_type = items.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(list=(_unit_rows(pdf["embedding"]) @ sent.value.T).argmax(axis=1))

    found = items.select("item_id", "embedding").filter("embedding IS NOT NULL").mapInPandas(
        run, f"item_id {item_type}, embedding {vector_type}, list long")
    return found.select("list", "item_id", "embedding")


def retrieve_approximate(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = TOP_K, probes: int = PROBES,
                         cell_rows: int = CELL_ROWS) -> DataFrame:
    """The ``k`` most similar items among the ``probes`` lists nearest to each query.

    ``index`` is a stored table of `inverted_lists`. Lists longer than ``cell_rows``
    are met in cells, which a query visits one by one; the best of a query's cells
    are ranked together. With as many probes as lists the result is exact.
    """
    item_type = index.schema["item_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    vector_type = queries.schema["embedding"].dataType.simpleString()
    unit, _, scan, named = _nearest(k)
    sent = index.sparkSession.sparkContext.broadcast(centres)

    def nearest_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and len(sent.value):
                close = _unit_rows(pdf["embedding"]) @ sent.value.T
                first = np.argsort(-close, axis=1, kind="stable")[:, :probes]
                rows = np.repeat(np.arange(len(pdf)), first.shape[1])
                yield pdf.iloc[rows].assign(list=first.ravel())

    # A table stored by list may read it back as another kind of number.
    index = index.withColumn("list", F.col("list").cast("long"))
    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).alias("cells"))
    asked = (queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
             .mapInPandas(nearest_lists, f"query_id {query_type}, embedding {vector_type}, list long")
             .join(sizes.toDF("list", "_cells"), "list").select(
                 "query_id", "embedding", F.col("list").alias("_list"), F.explode(F.expr("sequence(0L, _cells - 1)")).alias("_cell")))
    stored = index.join(F.broadcast(sizes), "list").withColumn("cell", F.pmod(F.xxhash64("item_id"), F.col("cells")))
    schema = f"query_id {query_type}, item_id {item_type}, similarity double"

    def meet(item_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(item_rows) or not len(query_rows):
            return named(pd.DataFrame({"q": [], "item_id": [], "similarity": []}), [])
        found = scan(unit(query_rows["embedding"]), item_rows["item_id"].to_numpy(), unit(item_rows["embedding"]))
        return named(found, query_rows["query_id"].tolist())

    met = stored.groupBy("list", "cell").cogroup(asked.groupBy("_list", "_cell")).applyInPandas(meet, schema)
    return _finish(met, k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: of the pairs in ``exact``, the share that ``found`` has too."""
    pairs = ["query_id", "item_id"]
    both = exact.select(*pairs).join(found.select(*pairs, F.lit(1).alias("hit")), pairs, "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"),
                    (F.count("hit") / F.count(F.lit(1))).alias("recall"))
