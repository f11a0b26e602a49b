import random

import pytest

from llm.conftest import AWKWARD
from termwise.llm import neardup, registry
from termwise.llm.components import components


def set_of(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent=80):
    """{position: (n, component)} by comparing all pairs of different sets."""
    sets = [set_of(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    classes = {}
    for i, s in enumerate(sets):
        if s and rows[i][0] is not None:
            root[find(i)] = find(classes.setdefault(s, i))
    reps = sorted(classes.items(), key=lambda x: len(x[0]))
    for k, (a, i) in enumerate(reps):
        for b, j in reps[k + 1:]:
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            first[find(i)] = min(first.get(find(i), doc), doc)
    return [(doc, len(sets[i]), first.get(find(i)) if doc is not None else None) for i, (doc, _) in enumerate(rows)]


def check(got, want):
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op6_against_all_pairs(spark, sf):
    docs = registry.table(spark, f"/root/testdata/{sf}", "documents").collect()
    check(registry.op6_near_duplicates(spark, f"/root/testdata/{sf}").collect(),
          brute([(r.doc_id, r.text) for r in docs], 2))


@pytest.mark.parametrize(("width", "chunk"), [(2, 2048), (5, 2048), (2, 5)])
def test_groups_chains_and_copies(spark, documents, monkeypatch, width, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rnd = random.Random(width)
    words = [f"w{i}" for i in range(4000)]
    texts = [rnd.choices(words, k=rnd.choice([20, 60, 200])) for _ in range(40)]
    for base in texts[:20]:
        for _ in range(rnd.randrange(1, 8)):  # copies with a few words changed, about the threshold
            copy = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // 20))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(copy)
    chain = rnd.choices(words, k=120)
    for i in range(14):  # each like the next, the ends unlike
        texts.append(chain[i * 6:i * 6 + 100])
    passage = rnd.choices(words, k=60)
    texts += [passage + rnd.choices(words, k=rnd.choice([5, 8, 14, 30])) for _ in range(60)]
    rows = [(i, " ".join(x).title() if i % 3 else " \n".join(x), None, None) for i, x in enumerate(texts)]
    rows += [(1000 + i, " ".join(texts[0]), None, None) for i in range(50)]
    rows += [(2000 + i, x, None, None) for i, x in enumerate(AWKWARD)]
    rows += [(None, "no id here", None, None), (7, rows[7][1], None, None), (7, "the same id another text", None, None)]
    got = neardup.near_duplicates(documents(rows).withColumnRenamed("n_chars", "kept"), width).collect()
    check(got, brute([r[:2] for r in rows], width))
    assert {"doc_id", "text", "lang", "source", "n_shingles", "component_id", "kept"} == set(got[0].asDict())


def test_a_chunk_sends_fewer_links_than_it_has_classes(spark):
    """All of a group alike, no leader's help: the links that go out only span it."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    sets = sorted((neardup.shingles(" ".join(base[:k] + [f"n{k}"] + base[k:]).encode(), 2) for k in rnd.sample(range(300), 60)), key=len)
    drawn = neardup.np.array([neardup.samples(x) for x in sets])
    group = neardup.pa.table({
        "low": [0] * 60, "high": [0] * 60, "chunk": [0] * 60, "node": range(60), "comp": range(60), "n": [len(x) for x in sets],
        "sketch": [x.view("<i8").tolist() for x in neardup.odd_sketch(drawn)], "whole": [x.view("<i8").tolist() for x in sets]})
    a, b = neardup._pairs_of(group, 80)
    assert len(a) == 59 and len({*a, *b}) == 60


def test_other_columns_stay_as_they_are(documents):
    docs = documents([(i, f"some words of text {i % 3}", None, None) for i in range(9)])
    for name in ("_first", "_node", "_root", "node", "_rest"):
        docs = docs.withColumn(name, neardup.F.concat(neardup.F.lit(name), "doc_id"))
    got = neardup.near_duplicates(docs, root=True).collect()
    assert all(r["_first"] == f"_first{r.doc_id}" and r["_rest"] == f"_rest{r.doc_id}" for r in got)
    assert len({r.component_root for r in got}) == 3


def test_nothing(spark, documents):
    assert neardup.near_duplicates(documents(["x"]).limit(0)).count() == 0
    assert [tuple(r) for r in neardup.near_duplicates(documents([None]), keep=["doc_id"]).collect()] == [(0, 0, 0, True)]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(500, 3), (3, 3), (900, 901), (901, 900), (901, 902)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert {k: got[k] for k in got} == {k: v for k, v in want.items()}
