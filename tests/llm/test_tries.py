import hashlib
import random
import zlib

import pytest

from llm.conftest import AWKWARD
from termwise.llm import tries

def n_words(text):
    return len((text or "").encode().split())


def brute(rows):
    """Node rows of (conv_id, turn, role, text) rows by sets of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, _digest(role, text), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    children = {}
    for x in nodes:
        if x:
            children.setdefault(x[:-1], []).append(x)
    out = []

    def walk(x):
        saved = (len(nodes[x]) - 1) * n_words(x[-1][1]) if x else 0
        leaves = 0 if x in children else 1
        for y in children.get(x, []):
            s, n = walk(y)
            saved, leaves = saved + s, leaves + n
        ids = sorted(c for c in nodes[x] if len(seqs[c]) == len(x))
        out.append((min(nodes[x]), len(x), min(nodes[x[:-1]]) if x else None, len(nodes[x]), len(children.get(x, [])),
                    leaves, saved, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
        return saved, leaves

    if () in nodes:
        walk(())
    return sorted(out, key=repr)


def _digest(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()


def made(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def run(frame, shard):
    got = tries.trie(tries.with_shared_openings(tries.sequences(frame)), shard)
    return sorted((tuple(r) for r in got.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def random_rows(seed, convs=70):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        turns = rng.choice([[], ["hi there"], ["hi there", "a"], ["hi there", "a", "b c d"]]) + [
            rng.choice(["x", "y y", None, "", "hi there"]) for _ in range(rng.randrange(5))]
        rows += [(c * rng.choice([1, 1, 3]), i, rng.choice(["user", "user", None, ""]), t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("shard", [200_000, 25, 4])
def test_against_sets_of_prefixes(spark, shard):
    rows = random_rows(shard)
    assert run(made(spark, rows), shard) == brute(rows)


def test_boundary_nodes_of_copies_deep_chains_and_prefixes(spark, monkeypatch):
    chain = [(c, i, "user", f"t{i} t") for c in (0, 20, 40, 61, 80) for i in range(60 + c)]
    copies = [(c, i, "user", f"t{i} t") for c in range(100, 160) for i in range(3)]
    rows = chain + copies + [(c, 0, None, None) for c in range(200, 230)] + [(-7, 5, "a", "b"), (-20, 1, "a", "c"), (-7, None, "", "")]
    monkeypatch.setattr(tries, "CHUNK", 4)
    assert run(made(spark, rows), 30) == brute(rows)


def test_awkward_rows_and_clashing_columns(spark):
    rows = [(i % 5, None if i % 7 == 0 else i % 3, "user", t) for i, t in enumerate(AWKWARD)]
    rows += rows[:6] + [(None, 1, "user", "lost"), (9, None, None, None)]
    frame = made(spark, rows)
    for name in ("key", "ids", "words", "seq", "shard", "n", "base", "h", "depth"):
        frame = frame.withColumn(name, tries.F.lit("kept out"))
    assert run(frame, 10) == brute(rows)
    assert run(made(spark, rows).limit(0), 10) == []


def test_search_tree_walks_in_order():
    rng = random.Random(3)
    seqs = sorted({tuple(rng.randrange(9) for _ in range(rng.randrange(6))) for _ in range(300)})
    tree = tries.Tree()
    ends = {}
    for i in tries.medians(len(seqs)):
        ends[tree.insert(list(seqs[i]), [1] * len(seqs[i]))] = i
    assert sorted(tries.medians(len(seqs))) == list(range(len(seqs)))
    order = list(tree.in_order())
    assert len(order) == len(set(order)) == len(tree.key)
    assert [ends[x] for x in order if x in ends] == list(range(len(seqs)))
    assert all(order.index(tree.parent[x]) < i for i, x in enumerate(order) if x)
