import random
from itertools import product
from zlib import crc32

import numpy as np
import pytest

from llm.conftest import AWKWARD
from termwise.llm import registry, toxicity

SF = "/root/testdata/sf0.1"


def test_chain_against_all_paths():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 1, 6])
    e, moves = rng.normal(0, 2, 11), rng.normal(0, 1, 4)
    _, _, got = toxicity.chain(e, lengths, moves)
    at = 0
    for n in lengths:
        weight, hits = 0.0, np.zeros(n)
        for path in product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + i] for i in range(n) if path[i]) + sum(moves[2 * a + b] for a, b in zip(path, path[1:])))
            weight, hits = weight + w, hits + w * np.array(path)
        assert got[at:at + n] == pytest.approx(hits / weight)
        at += n


def test_held_out(spark):
    labels = {r.doc_id: r.toxic for r in registry.table(spark, SF, "labels").collect()}
    rows = registry.op3_toxicity(spark, SF).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    assert sum(toxic) >= 0.8 * len(toxic)
    assert sum(clean) <= 0.02 * len(clean)


@pytest.fixture(scope="module")
def trained(spark):
    rnd = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(160):
        text = rnd.choices(words, k=30)
        if toxic := i % 4 == 0:
            text[rnd.randrange(30)] = rnd.choice(["horrid", "vilestuff", "vilesome"])
        rows.append((i, " ".join(text), int(toxic)))
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int")), words


def test_spans_point_at_the_words(trained):
    model, words = trained
    text = f"Ünder {words[0]} HORRID, {words[1]} {words[2]} vilesomething {words[3]}"
    (score,), (spans,) = model.score([text])
    assert score >= 0.3 and {text[s["start"]:s["end"]] for s in spans} == {"HORRID", "vilesomething"}
    assert model.score([" ".join(words[:20])]) == ([pytest.approx(0, abs=0.3)], [[]])


def test_awkward_texts(spark, documents, trained):
    model, _ = trained
    docs = documents(AWKWARD).withColumnRenamed("source", "score").withColumnRenamed("n_chars", "spans")
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(AWKWARD) and all(r.predicted == 0 and r.spans == [] for r in rows)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_one_sided_labels(spark, documents):
    schema = "doc_id long, text string, toxic int"
    for rows in ([], [(1, "a b", 1)], [(1, "a b", 0), (2, None, 1), (3, "c", None)]):
        model = toxicity.fit(spark.createDataFrame(rows, schema))
        assert [r.score for r in toxicity.score(documents(["a b"]), model).collect()] == [0.0]


def test_every_chosen_form_is_trained(spark):
    """More toxic documents than any sample of 400, terms in long ones alone too."""
    rnd = random.Random(2)
    plain = [f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    terms = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(60)]
    rows = [(i, " ".join([*rnd.choices(plain, k=9), terms[i % 60]]), 1) for i in range(1500)]
    rows += [(2000 + i, " ".join([*rnd.choices(plain, k=25_000), "longone"]), 1) for i in range(20)]
    rows += [(3000 + i, " ".join(rnd.choices(plain, k=10)), 0) for i in range(1500)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4))
    assert {f"={x}" for x in [*terms, "longone"]} <= set(model.lexicon)
    assert min(model.weights[model.lexicon[f"={x}"]] for x in [*terms, "longone"]) > 0.5
    _, spans = model.score([f"{plain[0]} {plain[1]} {x} {plain[2]}" for x in [*terms, "longone"]])
    assert all(len(s) == 1 for s in spans)


def test_gradient_of_pieces():
    """Against differences of the log likelihood summed over all paths."""
    rng = np.random.default_rng(5)
    lengths, sizes = np.array([3, 2, 4]), np.array([0, 2, 0, 1, 1, 0, 0, 3, 1])
    numbers, toxic, weight = rng.integers(0, 4, sizes.sum()), np.array([1, 0, 1]), np.array([2.0, 0.5, 3.0])

    def likelihood(theta):
        before, after = toxicity.neighbours(sizes > 0, lengths)
        sums = [theta[numbers[hi - n:hi]].sum() for n, hi in zip(sizes, np.cumsum(sizes))]
        e = theta[4] + np.array(sums) + theta[5] * before + theta[6] * after
        total, at = 0.0, 0
        for n, label, w in zip(lengths, toxic, weight):
            def log(path):
                return sum(e[at + i] * s for i, s in enumerate(path)) + sum(
                    theta[7 + 2 * a + b] for a, b in zip(path, path[1:]))
            truth = tuple(int(x > 0 and label) for x in sizes[at:at + n])
            total += w * (log(truth) - np.log(sum(np.exp(log(x)) for x in product((0, 1), repeat=int(n)))))
            at += n
        return total

    theta = rng.normal(0, 1, 11)
    got = toxicity.gradient(theta, lengths, sizes, numbers, toxic, weight)
    for i in range(11):
        step = np.eye(11)[i] * 1e-6
        assert got[i] == pytest.approx((likelihood(theta + step) - likelihood(theta - step)) / 2e-6, abs=1e-5)


def test_pieces_hold_every_token():
    kinds = np.random.default_rng(1).choice([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 2], 3000)
    for x in (kinds, kinds * 0, kinds + 1, kinds[:1], kinds[:0]):
        assert np.concatenate([x[:0], *toxicity.cut(x)]).tolist() == x.tolist()
        assert max(map(len, toxicity.cut(x)), default=0) <= toxicity.PIECE


def test_every_form_is_tested(spark, monkeypatch):
    """A bound on the chosen forms leaves the strongest, not the most frequent of all."""
    monkeypatch.setattr(toxicity, "FORMS", 5)
    plain = [f"p{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join([*plain, *(["zq"] if i < 40 else [])]), int(i < 50)) for i in range(100)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert list(model.lexicon) == ["=zq"]


def test_ratio_by_hand(spark):
    cases = [(40, 0, 50, 50), (3, 0, 10, 1000), (50, 50, 50, 50), (7, 2, 9, 30), (1, 9, 10, 10), (10, 3, 10, 40)]
    for a, b, of_a, of_b in cases:
        row = spark.createDataFrame([(a, b)], "a long, b long")
        got = row.select(toxicity.likelihood_ratio(row.a, row.b, of_a, of_b)).first()[0]

        def log(k, n, p):
            return sum(x * np.log(y) for x, y in ((k, p), (n - k, 1 - p)) if x)

        both = (a + b) / (of_a + of_b)
        want = 2 * (log(a, of_a, a / of_a) + log(b, of_b, b / of_b) - log(a, of_a, both) - log(b, of_b, both))
        assert got == pytest.approx(want if a * of_b > b * of_a else 0.0, abs=1e-9)


def test_labelled_texts_and_the_sample(spark, documents, monkeypatch):
    docs = documents([(i, f"text {i}", None, None) for i in range(300)] + [(7, "text 7 again", None, None), (None, "x", None, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)] + [(-5, 1), (None, 1)], "doc_id long, toxic int")
    want = sorted([(i, f"text {i}", i % 2) for i in range(0, 300, 3)])
    for marks in (1 << 25, 1 << 15, 64):
        # A small bitmap lets more through to the join, and no label is lost.
        monkeypatch.setattr(toxicity, "MARKS", marks)
        assert sorted(map(tuple, toxicity.labelled(docs, labels).collect())) == want
    few = toxicity._sample(docs, 302, 100).collect()
    assert 60 < len(few) < 140 and few == toxicity._sample(docs, 302, 100).collect()
    assert toxicity._sample(docs, 302, 302).count() == 302


def test_the_curve_is_fitted_on_batches_as_on_single_texts(spark):
    model = toxicity.ToxicModel({"f:bad": 0})
    model.weights = toxicity.np.array([2.0])
    model.bias = -1.0
    model.sums = toxicity.np.zeros(0)
    texts = ["bad words", None, "", "other bad text " * 50, "fine", "bad"]
    single = [model.facts([x])[0][0].tolist() for x in texts]
    assert toxicity.np.allclose([x for g in toxicity.grouped(texts) for x in model.facts(g)[0].tolist()], single)
