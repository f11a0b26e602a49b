import math
import pickle
import re
import tracemalloc
from collections import Counter, defaultdict
from zlib import crc32

import pyarrow as pa
import pytest

from llm.conftest import AWKWARD
from termwise.llm import langid, registry

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in registry.table(spark, SF, "documents").collect()}
    rows = registry.op4_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and re.search(r"[^\W\d_]", docs[r.doc_id].text or "")]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def brute(train, text):
    """The same backoff, by plain counting."""
    words, grams = defaultdict(Counter), {n: defaultdict(Counter) for n in range(1, 6)}
    for t, lang in train:
        for w in langid.words_of(t):
            words[lang][w] += 1
            for n in langid.ORDERS:
                for g in langid.grams_of(w, n):
                    grams[len(g)][lang][g] += 1
    langs = sorted(words)
    known = set().union(*words.values())
    of_order = {n: set().union(*x.values()) if x else set() for n, x in grams.items()}

    def log(counts, item, kinds):
        return math.log((counts[item] + 0.5) / (sum(counts.values()) + 0.5 * kinds + 0.5))

    sums = dict.fromkeys(langs, 0.0)
    for w in langid.words_of(text):
        if w in known:
            for x in langs:
                sums[x] += log(words[x], w, len(known))
            continue
        for n in langid.ORDERS:
            if found := [g for g in langid.grams_of(w, n) if g in of_order[len(g)]]:
                for x in langs:
                    sums[x] += sum(log(grams[len(g)][x], g, len(of_order[len(g)])) for g in found) / len(found)
                break
    return sums


def test_backoff_by_brute_force(spark, documents):
    train = [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"),
             ("the cat and the dog", "en"), (None, "en"), ("kein", None), ("", "de"), ("123 !", "fr")]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    assert model.langs == ["de", "en", "fr"]
    for text in ["the chien", "Katzen", "doggy xyzzy", "q", "Hund the le", "ø", "hundehund und cathedral"]:
        want = brute([x for x in train if None not in x], text)
        (best,), (share,) = model.predict([text])
        assert best == max(sorted(want), key=lambda x: round(want[x], 9)), text
        assert share == pytest.approx(1 / sum(math.exp(x - want[best]) for x in want.values()))


def test_awkward_texts_and_columns(spark, documents):
    docs = documents(AWKWARD).withColumnRenamed("source", "lang_pred").withColumnRenamed("n_chars", "score")
    model = langid.fit(docs.limit(8))
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(AWKWARD) and set(rows[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score"}
    for r in rows:
        letters = bool(r.text and re.search(r"[^\W\d_]", re.sub("[½Ⅷ]", "", r.text)))
        assert (r.lang_pred == "und") == (not letters)
    assert langid.predict(docs.limit(0), model).count() == 0


def test_nothing_to_learn(spark, documents):
    model = langid.fit(documents(["x"]).limit(0))
    assert [(r.lang_pred, r.score) for r in langid.predict(documents(["words"]), model).collect()] == [("und", 0.0)]


def test_unseen_cache_starts_afresh(spark, monkeypatch):
    train = [("alpha beta gamma", "en"), ("alfa beta gama", "es")]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    texts = [f"alph{'a' * i} bet{'o' * i} gam{'e' * i}" for i in range(30)]
    want = model.predict(texts)
    monkeypatch.setattr(langid, "UNSEEN", 2)
    again = langid.LanguageModel.__new__(langid.LanguageModel)
    again.__dict__.update({k: v for k, v in model.__dict__.items() if k not in ("at", "rows")})
    assert again.predict(texts) == want


def test_a_small_language_keeps_its_words(spark):
    """One language with far more of everything does not push out another's words or n-grams."""
    big = [(" ".join(f"{a}{b}{c}" for c in "aeiou"), "big") for a in "bcdfghjklm" for b in "aeiou"] * 5
    small = [("xyzzy wyrrd zyxxw", "tiny")]
    frame = spark.createDataFrame(big + small, "text string, lang string")
    model = langid.fit(frame, known=20, grams=20)
    assert {"xyzzy", "wyrrd", "zyxxw"} <= set(model.words)
    assert {"xyzz", "zzy", "xy", "x"} <= set(model.grams)
    assert sum(w not in ("xyzzy", "wyrrd", "zyxxw") for w in model.words) == 20
    assert model.predict(["xyzzy", "wyrrdz"])[0] == ["tiny", "tiny"]


def test_a_worker_holds_little(monkeypatch):
    """Counts of all languages together are given on in parts, and n-gram scores are one array."""
    monkeypatch.setattr(langid, "_PART", 50)
    langs = [f"l{i}" for i in range(20)]
    texts = [f"{a}{b} {b}{a}{b} {a}" for a in "abcdefghij" for b in "klmnopqrst"]
    batches = [pa.record_batch({"lang": langs, "text": [x] * 20}) for x in texts]
    want = Counter((x, w) for x in langs for t in texts for w in langid.words_of(t))
    got = list(langid._count_words(iter(batches)))
    found = Counter()
    for b in got:
        for x, w, n in zip(*(b.column(c).to_pylist() for c in ("lang", "item", "n"))):
            found[x, w] += n
    assert found == want and len(got) > 20 * len(texts) // 2
    words = pa.record_batch({"lang": ["l0"] * 100, "item": [f"w{i}x{i}" for i in range(100)], "n": [1] * 100})
    assert max(b.num_rows for b in langid._count_grams(iter([words]))) < 100
    grams = {f"{i:04x}": [i + k for k in range(20)] for i in range(5000)}
    held = pickle.dumps(langid.LanguageModel(langs, {"w": [1] * 20}, grams, [9] * 20))
    tracemalloc.start()
    model = pickle.loads(held)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 2_000_000 and len(model.unseen("00ff")[0]) == 20
