import numpy as np
import pytest

from termwise.operators.retrieval import retrieve_topk


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    items = rng.integers(-2, 3, size=(200, 3)).astype(float)  # small range, so many exact ties
    items[items.any(axis=1) == 0] = [1.0, 0.0, 0.0]
    queries = rng.normal(size=(9, 3))
    item_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)],
                                    "item_id long, embedding array<double>").repartition(5)
    query_df = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)],
                                     "query_id string, embedding array<double>")
    unit = items / np.linalg.norm(items, axis=1, keepdims=True)
    asked = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    close = (asked[:, None] * unit[None]).sum(axis=2)
    want = {}
    for q in range(len(queries)):
        order = sorted(range(len(items)), key=lambda i: (-close[q, i], i))[:6]
        want[f"q{q}"] = order
    return item_df, query_df, want


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["item_id"])
    return out


def test_sent_batch_matches_brute_force(vectors):
    items, queries, want = vectors
    assert _found(retrieve_topk(items, queries)) == want


def test_grid_matches_brute_force(vectors):
    items, queries, want = vectors
    assert _found(retrieve_topk(items, queries, query_batch=2, cell_rows=30)) == want


def test_fewer_items_than_k(vectors):
    items, queries, _ = vectors
    assert all(len(v) == 2 for v in _found(retrieve_topk(items.limit(2), queries)).values())


def test_nothing_stored_or_asked(vectors):
    items, queries, _ = vectors
    assert retrieve_topk(items.limit(0), queries).count() == 0
    assert retrieve_topk(items, queries.limit(0)).count() == 0


@pytest.mark.parametrize("batch", [4096, 1])
def test_neighbours_closer_than_what_is_shown(spark, batch):
    # Rising similarity in steps far below the sixth digit.
    rows = [(i, [1.0, 1e-3 - i * 1e-6]) for i in range(50)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0])], "query_id string, embedding array<double>")
    assert _found(retrieve_topk(items, asked, query_batch=batch)) == {q: [49, 48, 47, 46, 45, 44] for q in "ab"}


def test_all_lists_probed_is_exact(vectors):
    from termwise.operators import retrieval

    items, queries, want = vectors
    centres = retrieval.fit_centroids(items, lists=7)
    index = retrieval.inverted_lists(items, centres)
    assert index.count() == 200 and index.select("list").distinct().count() <= 7
    for cell_rows in (100_000, 9):
        assert _found(retrieval.retrieve_approximate(index, centres, queries, probes=7, cell_rows=cell_rows)) == want


def test_a_list_with_a_third_of_all_items(spark, vectors):
    from termwise.operators import retrieval

    items, queries, _ = vectors
    same = spark.range(1000, 1100).selectExpr("id AS item_id", "array(1D, 2D, 0.5D) AS embedding")
    every = items.unionByName(same)
    centres = retrieval.fit_centroids(every, lists=10, fit_rows=150)
    index = retrieval.inverted_lists(every, centres)
    found = retrieval.retrieve_approximate(index, centres, queries, probes=6, cell_rows=20)
    measured = retrieval.recall(retrieval.retrieve_topk(every, queries), found).first()
    assert measured.wanted == 54 and measured.recall >= 0.9


def test_index_of_nothing(spark, vectors):
    from termwise.operators import retrieval

    items, queries, _ = vectors
    centres = retrieval.fit_centroids(items.limit(0))
    assert retrieval.retrieve_approximate(retrieval.inverted_lists(items.limit(0), centres), centres, queries).count() == 0
    centres = retrieval.fit_centroids(items.limit(3))
    some = retrieval.retrieve_approximate(retrieval.inverted_lists(items.limit(3), centres), centres, queries)
    assert all(len(v) == 3 for v in _found(some).values())
