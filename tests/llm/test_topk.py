import math
import random

import numpy as np
import pyarrow as pa
import pytest

from termwise.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in ok if i % 50 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), k).collect())


@pytest.mark.parametrize("block", [8, 1024])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rnd = random.Random(block)
    rows = [(i, [rnd.gauss(0, 1) * (1 + (i % 7) ** 2) for _ in range(6)]) for i in range(260)]
    # Ties, a large group of equal vectors, zeros, broken vectors and no vector.
    rows += [(300 + i, [0.5] * 6) for i in range(60)] + [(400, [0.0] * 6), (450, [0.001] * 6), (451, [-9.0] * 6)]
    rows += [(500, None), (550, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (600, [math.nan] * 6), (601, [math.inf] * 6),
             (None, [1.0] * 6), (650, []), (651, [3.0, 4.0])]
    assert run(spark, rows) == brute(rows)


def test_high_thresholds_prune_by_coordinates():
    rnd = np.random.default_rng(5)
    c = np.floor(rnd.normal(0, 1, (400, 8)) * 100)
    c = c[np.argsort(-(c * c).sum(1))]
    q = np.concatenate([c[:40] * 2, rnd.integers(-50, 50, (10, 8)).astype(float), np.zeros((1, 8))])
    ids = np.arange(400)
    scores = (q @ c.T).astype(int)
    for least in (-np.inf, 0.0, 1.0):
        lows = np.full(len(q), least) if least < 1 else np.sort(scores, 1)[:, -3].astype(float)
        got = {int(r): (i.tolist(), s.tolist()) for r, i, s in topk.best_of(q, np.full(len(q), -1), c, ids, lows, 5)}
        for row in range(len(q)):
            want = sorted((-s, i) for i, s in enumerate(scores[row]) if s >= lows[row])[:5]
            assert sorted(zip([-x for x in got.get(row, ([], []))[1]], got.get(row, ([], []))[0])) == want


def test_few_or_no_vectors(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [1.0, 0.0])]) == [(0, 1, 1, 65536)]
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0]), (0, [2.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 1.0]), (2, [1e6, 2.0]), (3, [-1e6, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_a_repeated_query_id_asks_for_one_vector(spark):
    """Whatever the order of the rows, the same vector is asked for."""
    base = spark.createDataFrame([(1000 + i, [math.cos(i), math.sin(i)]) for i in range(40)],
                                 "vec_id long, embedding array<double>")
    rows = [(q, [math.cos(q + j), math.sin(q + j)]) for q in range(8) for j in range(5)]
    got = []
    for order in (rows, rows[::-1]):
        asked = spark.createDataFrame(order, base.schema).coalesce(1)
        got.append(sorted(tuple(r) for r in topk.top_k(base, asked).collect()))
    assert got[0] == got[1] and len(got[0]) == 40


def test_nothing_is_broadcast(spark, monkeypatch):
    """Neither side goes through the driver, however small Spark takes it to be."""
    plans, write = [], topk.written

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(topk, "written", noted)
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)], 0) for i in range(200)], SCHEMA)
    noted(topk.top_k(df, df.filter("vec_id % 50 = 0")), "found")
    assert not any("Broadcast" in x for x in plans)
    assert sum("CoGroups" in x for x in plans) == 2


@pytest.mark.parametrize("cells", [1, 9])
def test_cells_of_a_few_blocks(spark, monkeypatch, cells):
    """Stripes and groups of several blocks, and a last one of fewer, find what one cell does."""
    for name, value in {"BLOCK": 4, "QUERIES": 2, "CELL": 480, "CELLS": cells, "TILE": 5, "STEP": 7}.items():
        monkeypatch.setattr(topk, name, value)
    rnd = random.Random(cells)
    rows = [(i * 10, [rnd.gauss(0, 1) * (1 + i % 5) for _ in range(5)]) for i in range(150)]
    rows += [(2000 + i, [1.0] * 5) for i in range(20)] + [(50, [2.0, 1.0, 0.0, 0.0, 0.0])]
    got = run(spark, rows)
    want = brute(rows)
    # Of the two vectors with id 50 either may be asked for.
    assert [x for x in got if x[0] != 50] == [x for x in want if x[0] != 50]
    assert [x for x in got if x[0] == 50] in [[x for x in brute([r for r in rows if r != own] + [(None, own[1])])
                                               if x[0] == 50] for own in rows if own[0] == 50]


@pytest.mark.parametrize("kind, size", [("<i1", 100), ("<i2", 500), ("<i2", 30000), ("<i4", 2**22), ("<f8", 2.0**25)])
def test_a_cell_is_exact_at_every_width(kind, size):
    """Single precision serves only where no sum can pass what it holds."""
    rnd = np.random.default_rng(7)
    q, c = (rnd.integers(-size, size, (n, 6)).astype(float) for n in (30, 300))
    c[200:] = c[:100] + rnd.integers(0, 2, (100, 6)) * (np.abs(c[:100]) < size / 2)
    ids = rnd.permutation(300)
    asked = pa.table({"q_ids": [np.arange(x, x + 15).astype("<i8").tobytes() for x in (0, 15)],
                      "q_data": [q[x:x + 15].astype(kind).tobytes() for x in (0, 15)],
                      "q_least": [np.full(15, -np.inf).tobytes(), np.zeros(15).tobytes()]})
    blocks = pa.table({"ids": [ids[x:x + 100].astype("<i8").tobytes() for x in (0, 100, 200)],
                       "data": [c[x:x + 100].astype(kind).tobytes() for x in (0, 100, 200)]})
    found = topk._search(5, 6, kind)(asked, blocks).to_pylist()
    for i in range(30):
        exact = [(-sum(int(a) * int(b) for a, b in zip(q[i], v)), int(j)) for v, j in zip(c, ids) if j != i]
        want = sorted(x for x in exact if i < 15 or x[0] <= 0)[:5]
        assert sorted((-x["score"], x["vec_id"]) for x in found if x["query_id"] == i) == want
