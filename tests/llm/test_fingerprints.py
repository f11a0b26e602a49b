import hashlib
import random

import numpy as np
import pytest

from llm.conftest import AWKWARD
from termwise.llm import fingerprints, registry


def set_of(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def exact(a, b):
    a, b = set_of(a), set_of(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def expected(docs):
    """{(doc_id, text): (n_chars, edited, next)} of (doc_id, text) rows in order."""
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (doc, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        text, after = text or "", after or ""
        edited = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, after))
    return out


def check(got, docs):
    got = sorted(got, key=lambda r: repr((r.doc_id, r.n_chars, r.edited_sha256)))
    want = sorted(expected(docs), key=lambda r: repr(r[:3]))
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == [r[:3] for r in want]
    for r, (*_, text, edited, after) in zip(got, want):
        assert r.jaccard_edited == pytest.approx(exact(text, edited), abs=1e-3)
        assert r.jaccard_next == pytest.approx(exact(text, after), abs=1e-3)
        assert abs(r.near_edited - r.jaccard_edited) < 0.25 and abs(r.near_next - r.jaccard_next) < 0.25
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 4 * fingerprints.SAMPLES
        if text == edited:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    return got


def test_op11_over_whole_documents(spark):
    docs = registry.table(spark, "/root/testdata/sf0.001", "documents").collect()
    got = check(registry.op11_fingerprints(spark, "/root/testdata/sf0.001").collect(), [(r.doc_id, r.text) for r in docs])
    marks = {}
    for r in docs:
        marks.setdefault(r.text, set()).update(x.fingerprint for x in got if x.doc_id == r.doc_id)
    assert all(len(x) == 1 for x in marks.values())
    assert np.mean([abs(r.near_edited - r.jaccard_edited) for r in got]) < 0.04


@pytest.mark.parametrize("rows", [
    [(i, t) for i, t in enumerate(AWKWARD)],
    [(None, "first of all")] + [(i * 7 % 31, f"text number {i} é🎉 " * (i % 5)) for i in range(31)],
    [(5, "alone in the table")], [(1, None)], [(1, "a b c d e f g h"), (2, "")],
])
def test_awkward_texts_and_ends_of_partitions(spark, documents, rows):
    docs = documents([(d, t, None, None) for d, t in rows])
    for name in ("part", "place", "next", "_tie", "fingerprint", "near_next"):
        docs = docs.withColumn(name, fingerprints.F.lit("kept out"))
    check(fingerprints.edited(docs).collect(), rows)


def test_empty_table_and_repeated_rows(spark, documents):
    assert fingerprints.edited(documents([(1, "x", None, None)]).limit(0)).count() == 0
    got = fingerprints.edited(documents([(7, "same words in every row here", None, None)] * 40)).collect()
    assert len(got) == 40 and all(r.near_next == 1 and r.doc_id == 7 for r in got)


def test_signature_is_the_least_of_each_permutation():
    found = fingerprints.shingles(b"one two three four five six seven eight nine ten " * 3 + b"end")
    a, b = fingerprints._A, fingerprints._B
    want = [min((int(x) * int(a[i]) + int(b[i])) % (1 << 64) >> 32 for x in found) for i in range(fingerprints.SAMPLES)]
    assert fingerprints.signature(found).tolist() == want


def groups_by_all_pairs(rows, percent=80):
    sets = {}
    for doc, text in rows:
        if doc is not None and set_of(text):
            sets.setdefault(frozenset(set_of(text)), []).append(doc)
    nodes = list(sets)
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(nodes):
        for j in range(i):
            both = len(x & nodes[j])
            if 100 * both >= percent * (len(x) + len(nodes[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(nodes):
        least[find(i)] = min([*sets[x], least.get(find(i), 1 << 60)])
    return sorted((doc, len(x), least[find(i)]) for i, x in enumerate(nodes) for doc in sets[x])


@pytest.mark.parametrize("leaders", [1, 16])
def test_groups_against_all_pairs(spark, documents, leaders):
    rng = random.Random(leaders)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(AWKWARD)]
    for g in range(12):
        # Of a group, neighbours are alike; the ends are not. All groups share a passage.
        words = shared + [f"g{g}w{i}" for i in range(rng.choice([30, 60, 120]))]
        for k in range(9):
            rows.append((len(rows), " ".join(words)))
            at = rng.randrange(len(words) - 6)
            words[at:at + 3] = [f"n{g}.{k}.{i}" for i in range(3)]
    rows += [(900 + i, rows[40][1].upper()) for i in range(15)] + [(None, rows[40][1])]
    got = fingerprints.near_groups(documents([(d, t, None, None) for d, t in rows]), leaders=leaders).collect()
    assert sorted(map(tuple, got)) == groups_by_all_pairs(rows)


def test_groups_of_nothing(documents):
    assert fingerprints.near_groups(documents([(1, None, None, None), (2, " ", None, None)])).count() == 0
    one = fingerprints.near_groups(documents([(4, "a b", None, None), (3, "c", None, None)])).collect()
    assert sorted(map(tuple, one)) == [(3, 1, 3), (4, 1, 4)]


def test_words_are_folded_by_place():
    assert fingerprints.shingles(b"a b c d e").tolist() != fingerprints.shingles(b"b a c d e").tolist()
    assert fingerprints.shingles(b"A B").tolist() == fingerprints.shingles(b"a  b\n").tolist()
    assert len(fingerprints.shingles(b"")) == 0
