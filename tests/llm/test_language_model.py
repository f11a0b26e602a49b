import math
from collections import Counter
from itertools import product
from zlib import crc32

import numpy as np
import pytest

from conftest import SF_DIR
from llm.conftest import AWKWARD
from termwise.llm import language_model as lm
from termwise.llm import registry


@pytest.fixture
def small(monkeypatch):
    for name, value in dict(UNITS=5, INPUTS=4, WIDTH=3, TAILS=4).items():
        monkeypatch.setattr(lm, name, value)
    rng = np.random.default_rng(0)
    network = lm.Network(7, np.float64)
    for k in network.p:
        network.p[k] = rng.normal(0, 0.5, network.p[k].shape)
    network.p["word_bias"][7:] = -40.0  # places of the last class that no word fills
    return network, rng


def test_gradients(small):
    network, rng = small
    docs = [rng.integers(0, 11, n).astype(np.int32) for n in (5, 1, 7, 3)]
    symbols, target, keep, live, _ = lm._streams(docs, 3, network.start)
    h = rng.normal(0, 1, (symbols.shape[1], 5))

    def loss():
        return network.loss_and_gradients(symbols, target, keep.astype(float), live, h)

    grad = loss()[1]
    for name in network.NAMES:
        got = grad[name]
        if name == "inputs":
            got = np.zeros_like(network.p[name])
            got[grad[name][0]] = grad[name][1]
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in network.p[name].shape)
            old, values = network.p[name][at], []
            for step in (1e-6, -1e-6):
                network.p[name][at] = old + step
                values.append(loss()[0])
            network.p[name][at] = old
            assert got[at] == pytest.approx((values[0] - values[1]) / 2e-6, abs=1e-4)


def test_state_goes_on_through_windows(small, monkeypatch):
    network, rng = small
    docs = [rng.integers(0, 11, n).astype(np.int32) for n in (40, 3, 90, 1, 17)]
    want = []
    for doc in docs:  # one step at a time
        h, total, last = np.zeros((1, 5)), 0.0, network.start
        table = network.p["inputs"] @ network.p["gates"] + network.p["bias"]
        for symbol in doc:
            out, _ = network.states(table[last][None, None], np.ones((1, 1)), h)
            h, last = out[0], symbol
            total += network.log_probs(h, np.array([symbol]))[0]
        want.append(total)
    for lanes, steps in ((256, 32), (2, 7), (1, 1)):
        monkeypatch.setattr(lm, "_SCORE_LANES", lanes)
        monkeypatch.setattr(lm, "_SCORE_STEPS", steps)
        assert network.scores(docs) == pytest.approx(want)


def test_symbols_are_a_distribution(small):
    network, _ = small
    h = np.linspace(-1, 1, 5)[None].repeat(11, 0)
    assert np.exp(network.log_probs(h, np.arange(11))).sum() == pytest.approx(1)


def brute_base(docs):
    train = Counter()
    for i, text in docs:
        if crc32(str(i).encode()) % 7 != 2:
            train.update((text or "").encode().lower().split())
            train[None] += 1
    n, v = sum(train.values()), len(train)
    out = {}
    for i, text in docs:
        tokens = [*(text or "").encode().lower().split(), None]
        out[i] = (crc32(str(i).encode()) % 7 == 2, len(tokens), sum(train[t] > 0 for t in tokens), n,
                  sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens))
    return out


def test_op1_base_and_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "LISTED", 3000)  # the join has work to do
    docs = [(r.doc_id, r.text) for r in registry.table(spark, SF_DIR, "documents").collect()]
    rows = registry.op1_lm_score(spark, SF_DIR).collect()
    want = brute_base(docs)
    assert len(rows) == len(docs)
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_is_the_network_and_the_tail(spark, documents, monkeypatch):
    """Every word's own probability, put together from its symbol and the counts."""
    monkeypatch.setattr(lm, "HEAD", 4)
    monkeypatch.setattr(lm, "LISTED", 6)
    texts = [" ".join(x) for x in product(["the", "The.", "cat", "dog,", "sat"], ["the", "zebra", "on", "on."])]
    docs = documents(texts)
    model = lm.fit(docs)
    counts = Counter(w for t in texts for w in t.lower().encode().split())
    head = [w.encode() for w in sorted((w.decode() for w in counts), key=lambda w: (-counts[w.encode()], w))][:3]
    tails = {}
    for w, c in counts.items():
        if w not in head:
            tails.setdefault(lm.tail_of(w), []).append(c)
    probe = ["the zebra", "unseen the on.", "", None, "CAT sat dog, zebu"]
    for r in lm.score(documents(probe), model).collect():
        words = (r.text or "").lower().encode().split()
        symbols = np.array([head.index(w) + 1 if w in head else 4 + lm.tail_of(w) for w in words] + [0], np.int32)
        want = float(model.network.scores([symbols])[0]) / math.log(10)
        for w in words:
            if w not in head:
                own = tails.get(lm.tail_of(w), [])
                want += math.log10((counts.get(w, 0) + 1) / (sum(own) + len(own) + 1))
        assert r.score == pytest.approx(want, abs=1e-4)


def test_awkward_texts_and_nothing(spark, documents):
    docs = documents(AWKWARD).withColumnRenamed("n_chars", "score")
    model = lm.fit(docs)
    rows = lm.score(docs, model).collect()
    assert len(rows) == len(AWKWARD) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if not r.text} == {1}
    assert lm.score(docs.limit(0), model).count() == 0
    empty = lm.fit(docs.limit(0))
    assert [r.base_score for r in lm.score(documents(["a b"]), empty).collect()] == [0.0]


def test_every_document_trains_once(spark, documents, monkeypatch):
    """The network sees each training text in one round, none in two."""
    seen = spark.sparkContext.accumulator(0)
    train = lm.Network.train

    def counted(self, docs, rate=lm.RATE):
        seen.add(len(docs))
        return train(self, docs, rate)

    def tasks(shared, run=lm._train):
        inner = run(shared)

        def start(batches):
            lm.Network.train = counted
            try:
                yield from inner(batches)
            finally:
                lm.Network.train = train

        return start

    monkeypatch.setattr(lm, "_train", tasks)
    lm.fit(documents([f"text {i} of many" for i in range(200)]))
    assert seen.value == 200


def test_classes_of_like_size_go_together(monkeypatch):
    """Each target's probability is that of its class times its own within it, by a few products for all classes."""
    network = lm.Network(lm.HEAD, np.float64)
    rng = np.random.default_rng(5)
    for name in ("classes", "class_bias", "words", "word_bias"):
        network.p[name] = rng.normal(0, 0.3, network.p[name].shape)
    h = rng.normal(0, 1, (900, lm.UNITS))
    target = np.concatenate([rng.integers(0, lm.WIDTH, 400), rng.integers(0, lm.HEAD + lm.TAILS, 500)])
    p, calls, exp = network.p, [], np.exp

    def own(h, x):
        head = x < lm.HEAD
        logits = h @ p["classes"].T + p["class_bias"]
        out = logits[x // lm.WIDTH if head else network.groups + x - lm.HEAD] - np.log(exp(logits).sum())
        if head:
            part = slice(x // lm.WIDTH * lm.WIDTH, (x // lm.WIDTH + 1) * lm.WIDTH)
            logits = p["words"][part] @ h + p["word_bias"][part]
            out += logits[x % lm.WIDTH] - np.log(exp(logits).sum())
        return out

    want = [own(*x) for x in zip(h, target)]
    monkeypatch.setattr(np, "exp", lambda x: calls.append(1) or exp(x))
    assert network.log_probs(h, target) == pytest.approx(want)
    assert len(calls) < 15
