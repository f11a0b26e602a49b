import random
import re
from collections import Counter, defaultdict

import pytest

from llm.conftest import AWKWARD
from termwise.llm import phrases


def pieces(text):
    raw = (text or "").encode().lower()
    return [p for x in re.split(rb"[.,;:!?\x0a-\x0d]", raw) if (p := re.findall(rb"[^\x20\x09]+", x))]


def counted(rows, longest):
    """{lang: (words, {phrase: n})} of (lang, text) rows."""
    out = defaultdict(lambda: [0, Counter()])
    for lang, text in rows:
        for words in pieces(text):
            entry = out["und" if lang is None else lang]
            entry[0] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    entry[1][tuple(words[i:i + k])] += 1
    return out


def brute(rows, least, longest=5, most=2000):
    out = []
    for lang, (n, f) in counted(rows, longest).items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        drop = {y[i:j] for y, a in found.items() for i in range(len(y)) for j in range(i + 1, len(y) + 1)
                if j - i < len(y) and a >= f[y[i:j]]}
        kept = []
        for p, a in found.items():
            if p not in drop:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, b" ".join(p), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score)
                for i, (score, a, p, left, right) in enumerate(sorted(kept)[:most])]
    return sorted(out)


def check(frame, want):
    assert sorted(tuple(r) for r in frame.collect()) == want


def random_rows(seed, texts=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["A", "É", "ω", "x-y", "\x1c", " "]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(texts):
        parts = [rng.choice(words[:8 + i % 20]) + rng.choice(["", "", "", ".", ",", "\n", " ;", "\t"]) for _ in range(rng.randrange(40))]
        if i % 3 == 0:
            parts[len(parts) // 2:len(parts) // 2] = passage
        rows.append((i, " ".join(parts), rng.choice(["en", "en", "de", None, "und", ""]), None))
    return rows


@pytest.mark.parametrize(("least", "most"), [(2, 2000), (4, 7), (30, 2000)])
def test_against_counting_every_phrase(documents, least, most):
    rows = random_rows(least)
    check(phrases.collocations(documents(rows), least, most=most), brute([(r[2], r[1]) for r in rows], least, most=most))


def test_results_do_not_depend_on_the_filter_or_on_batches(documents, monkeypatch):
    rows = random_rows(11, 60)
    want = brute([(r[2], r[1]) for r in rows], 3)
    monkeypatch.setattr(phrases, "FILTER", 1 << 15)
    check(phrases.collocations(documents(rows, 5), 3), want)
    # A full filter cuts nothing.
    monkeypatch.setattr(phrases, "frequent", lambda docs, least: phrases.np.full(phrases.FILTER // 8, 255, "u1"))
    check(phrases.collocations(documents(rows, 5), 3), want)


def test_flow_counts_what_the_texts_hold(documents):
    rows = random_rows(5)
    got = {(r.lang, tuple(r.phrase.encode().split(b" "))): r.n
           for r in phrases.flow(phrases.graph(documents(rows), 2)).collect()}
    for lang, (_, f) in counted([(r[2], r[1]) for r in rows], 5).items():
        for p, n in f.items():
            # A phrase of several words is whole if each of its pairs is frequent.
            if n >= 2:
                assert got[lang, p] == n


def test_paths_join_a_repeated_passage(documents):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [f"x{i} {passage} y{i}" for i in range(9)] + [f"p0 p1 p2 p3 p4. p30 p31 p32 p33 q{i}" for i in range(5)]
    counts = phrases.flow(phrases.graph(documents(rows), 5))
    got = sorted((r.path, r.n, r.edges) for r in phrases.paths(counts, 5).collect())
    words = passage.split()
    # The node p1..p4 ends five pieces, and p30..p33 is left by others too: paths end there.
    assert got == sorted([(" ".join(words[:5]), 14, 1), (" ".join(words[1:34]), 9, 29), (" ".join(words[30:]), 9, 36)])


def test_awkward_texts_hot_language_and_clashing_columns(spark, documents):
    rows = [(i, t, "en", None) for i, t in enumerate(AWKWARD * 4)]
    rows += [(None, "Same words here again", None, None)] * 12
    docs = documents(rows)
    for name in ("phrase", "n", "size", "rank", "h", "score", "at", "edge"):
        docs = docs.withColumn(name, phrases.F.lit("kept out"))
    check(phrases.collocations(docs, 4), brute([(r[2], r[1]) for r in rows], 4))
    assert phrases.collocations(documents([(1, None, None, None)]), 1).count() == 0
    assert phrases.collocations(documents([(1, "a b", "en", None)]).limit(0), 1).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    n, a, left, right = 9 * 10**15, 8 * 10**12 + 1, 9 * 10**12 + 7, 8 * 10**12 + 3
    counts = spark.createDataFrame([("en", "a b", 2, a), ("en", "a", 1, left), ("en", "b", 1, right)],
                                   "lang string, phrase string, size int, n long")
    total = spark.createDataFrame([("en", n)], "lang string, total long")
    got = phrases.scored(counts.filter("size > 1"), counts, total).first()
    assert got.score == 1000 * a * n // (left * right)


def test_rows_that_leave_the_tasks_follow_the_words(spark, documents):
    # Every word starts an edge of its own here, and no two edges of a task are equal.
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [" ".join(rnd.choices(words, k=500)) + ". alone" for _ in range(40)]
    docs = documents(rows, 2)
    whole = spark.sparkContext.broadcast(phrases.np.full(phrases.FILTER // 8, 255, "u1"))
    found = phrases.runs(docs, whole, 5).collect()
    parts = [r for r in found if len(r.words) > 1]
    assert len(parts) == 40 * -(-500 // phrases._RUN) and max(len(r.words) for r in parts) == phrases._RUN + 4
    assert sum(r.starts * r.n for r in found if r.words != [""]) == 40 * 501 == sum(r.n for r in found if r.words == [""])
    # A part holds whole every phrase that its first words start.
    edges = Counter()
    for r in parts:
        edges.update(" ".join(r.words[i:i + 5]) for i in range(r.starts))
    texts = [r.removesuffix(". alone").split() for r in rows]
    assert edges == Counter(" ".join(t[i:i + 5]) for t in texts for i in range(500))
