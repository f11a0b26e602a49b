"""Encoding, decoding, counting and token files against the public libraries."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

from conftest import SF_DIR
from llm.conftest import AWKWARD, TOKENIZERS
from termwise.llm import bpe, registry, token_files, unigram
from termwise.session import scratch_path

TEXT = st.text(st.one_of(st.sampled_from(" \n\t'the and of <|endoftext|>ing▁."), st.characters(codec="utf-8")), max_size=60)


def library(name):
    found = Tokenizer.from_file(f"{TOKENIZERS}/{name}")
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def byte_bpe():
    return library("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word_bpe():
    return library("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rules():
    return bpe.automaton(f"{TOKENIZERS}/byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return unigram.Counter(*unigram.vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def unigram_library(counter):
    found = Tokenizer(models.Unigram(counter.pieces, counter.unknown, byte_fallback=True))
    found.pre_tokenizer = pre_tokenizers.Metaspace()
    found.decoder = decoders.Metaspace()
    return found


def ids_of(rules, text):
    return np.frombuffer(rules.encode(text), "<i4").tolist()


@pytest.mark.parametrize("text", [x for x in AWKWARD if x])
def test_awkward_texts(text, rules, byte_bpe, counter, unigram_library):
    want = byte_bpe.encode(text, add_special_tokens=False).ids
    assert ids_of(rules, text) == want
    assert rules.decode(want) == byte_bpe.decode(want, skip_special_tokens=False)
    assert counter.count(text) == len(unigram_library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(text=TEXT)
def test_any_text(text, rules, byte_bpe, counter, unigram_library):
    want = byte_bpe.encode(text, add_special_tokens=False).ids
    assert ids_of(rules, text) == want
    assert rules.decode(want) == byte_bpe.decode(want, skip_special_tokens=False)
    assert counter.count(text) == len(unigram_library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(merges=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14),
       words=st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=8))
def test_automaton_applies_merges_in_order(merges, words):
    tokens, kept = {b"a": 0, b"b": 1, b"c": 2}, []
    for a, b in merges:
        names = list(tokens)
        if a < len(names) and b < len(names) and names[a] + names[b] not in tokens:
            tokens[names[a] + names[b]] = len(tokens)
            kept.append((names[a], names[b]))
    rules = bpe.Automaton(tokens, kept, {})
    rules.open()
    for word in words:
        run = [x.encode() for x in word]
        while pairs := [(kept.index(p), i) for i, p in enumerate(zip(run, run[1:])) if p in kept]:
            first = kept[min(pairs)[0]]
            out = []
            while run:
                if tuple(run[:2]) == first:
                    out, run = [*out, run[0] + run[1]], run[2:]
                else:
                    out, run = [*out, run[0]], run[1:]
            run = out
        assert [rules.labels[i] for i in rules.encode_word(word.encode())] == run


def test_words_with_marks_share_a_kept_answer(rules, byte_bpe):
    text = "some wordish, wordish\nwordish."
    mine = bpe.automaton(f"{TOKENIZERS}/byte_bpe_50k.json")
    assert ids_of(mine, text) == byte_bpe.encode(text, add_special_tokens=False).ids
    assert " wordish" in mine.chunks and "wordish" in mine.chunks and " wordish" not in mine.words


def test_undecodable_bytes(rules, byte_bpe):
    ids = [i for i in range(200, 260)] + [50256, 161, 162, 50000]
    assert rules.decode(ids) == byte_bpe.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=600))
def test_blocks_round_trip(ids):
    ids = np.array(ids, "<u4")
    payload = token_files.pack(ids)
    assert token_files.unpack(payload).tolist() == ids.tolist()
    for block in range(-(-len(ids) // token_files.BLOCK)):
        part = ids[block * token_files.BLOCK:(block + 1) * token_files.BLOCK]
        assert token_files.unpack(payload, block).tolist() == part.tolist()


def test_runs_of_ids_are_given_back():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon:")) >> 10

    ids, ends = np.arange(500_000, dtype="<u4"), np.arange(0, 500_001, 1000)[1:]
    assert b"".join(token_files.runs_of(ids, ends).to_pylist()) == ids.tobytes()
    payload = token_files.pack(ids)
    before = held()
    for _ in range(100):  # 200 MB of ids
        token_files.runs_of(token_files.unpack(payload), ends)
    assert held() - before < 60


def test_outliers_stay_out_of_the_width():
    ids = np.full(token_files.BLOCK, 7, "<u4")
    ids[::20] = 2**31
    assert len(token_files.pack(ids)) < 100
    assert token_files.unpack(token_files.pack(ids)).tolist() == ids.tolist()


def test_encode_and_decode_frames(spark, documents, byte_bpe, rules):
    docs = documents(AWKWARD).withColumnRenamed("n_chars", "ids")  # a clashing column is replaced
    rows = bpe.decode(bpe.encode(docs, rules), rules).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        want = byte_bpe.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == byte_bpe.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), rules).count() == 0


def test_round_trip_takes_one_python_worker_a_task(spark, documents, rules):
    docs = documents(AWKWARD)
    both = bpe.round_trip(docs, rules).select("doc_id", "ids", "decoded")
    parted = bpe.decode(bpe.encode(docs, rules), rules).select("doc_id", "ids", "decoded")
    assert sorted(both.collect(), key=str) == sorted(parted.collect(), key=str)
    assert registry.op2_bpe(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_decoding_sends_labels_only(spark, documents, rules, monkeypatch):
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or broadcast(self, x))
    ids = bpe.encode(documents(["some words"]), rules)
    del sent[:]
    assert bpe.decode(ids, rules).first().decoded == "some words"
    assert sent == [rules.labels]


def brute_files(docs, word_bpe):
    out, start = [], 0
    for r in sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*word_bpe.encode(r.text or "", add_special_tokens=False).ids, 2]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(df):
    return [tuple(r) for r in df.orderBy("start").selectExpr("doc_id", "start", "n_tokens", "crc32(ids)").collect()]


def test_token_files(spark, documents, word_bpe, monkeypatch):
    docs = documents([(i * 7 % 27 if i else None, x, None, None) for i, x in enumerate(AWKWARD)], 4)
    path = scratch_path(spark, "t")
    token_files.write_tokens(docs, f"{TOKENIZERS}/word_bpe_49k.json", path, 2)
    assert read(token_files.read_tokens(spark, path)) == brute_files(docs.collect(), word_bpe)


def test_token_files_of_nothing(spark, documents):
    path = scratch_path(spark, "t")
    token_files.write_tokens(documents(["x"]).limit(0), f"{TOKENIZERS}/word_bpe_49k.json", path, 2)
    assert token_files.read_tokens(spark, path).count() == 0


def test_op2(spark, byte_bpe):
    docs = {r.doc_id: r.text for r in registry.table(spark, SF_DIR, "documents").collect()}
    rows = registry.op2_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = byte_bpe.encode(docs[r.doc_id], add_special_tokens=False).ids
        text = byte_bpe.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


def test_op5(spark, word_bpe):
    docs = registry.table(spark, SF_DIR, "documents").collect()
    got = sorted((tuple(r) for r in registry.op5_token_files(spark, SF_DIR).collect()), key=lambda r: r[1])
    assert got == brute_files(docs, word_bpe)


def test_op9(spark, unigram_library):
    docs = {r.doc_id: r.text for r in registry.table(spark, SF_DIR, "documents").collect()}
    rows = registry.op9_token_counts(spark, SF_DIR).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {
        i: len(unigram_library.encode(x, add_special_tokens=False).ids) for i, x in docs.items()}
