import regex
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF_DIR
from llm.conftest import AWKWARD, TOKENIZERS
from llm.test_neardup import brute
from llm.test_quality_mixing import reshared
from test_governance import exchanged
from termwise.llm import quality
from termwise.llm.registry import table
from termwise.llm.texts import written


def test_against_brute_force(spark):
    """Stage by stage on the stage's own input, then the whole run."""
    docs = table(spark, SF_DIR, "documents")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], SF_DIR), name))
    assert all(f.columns == columns for f in frames[:-1])
    start, spoken, good, single, mixed, tokens = ([r.asDict() for r in f.collect()] for f in frames)
    assert {r["doc_id"] for r in spoken} == {r["doc_id"] for r in start if regex.search(r"\p{L}", r["text"] or "")}
    fails = {r["doc_id"]: [not (m[0] >= 50), 100 * m[5] > 50 * m[0], 10 * m[2] > m[0], 2 * m[4] > m[3],
                           m[1] < 2 * m[0] or m[1] > 20 * m[0]]
             for r in spoken for m in [quality.measure_text(r["text"].encode())]}
    assert {r["doc_id"] for r in good} == {k for k, v in fails.items() if not any(v)}
    found = brute([(r["doc_id"], r["text"]) for r in good], 5)
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, _, c in found})
    sizes = {}
    for r in single:
        sizes.setdefault(r["source"], []).append(len(r["text"].encode().split()))
    names = sorted(sizes)
    totals = [sum(sizes[x]) for x in names]
    targets = reshared(totals, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(totals))
    for name, target in zip(names, targets):
        taken = sum(len(r["text"].encode().split()) for r in mixed if r["source"] == name)
        assert abs(taken - target) <= 2 * max(sizes[name])
    texts = {r["doc_id"]: r["text"] for r in start}
    library = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    assert len(tokens) == len(mixed)
    for r in tokens:
        assert r["same"] and r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.ids) for r in whole) == sorted((r["doc_id"], r["ids"]) for r in tokens)


def test_awkward_rows_pass_every_stage(spark, documents):
    clean = " ".join(f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(i, x, None if i % 5 else "en", None if i % 7 == 0 else "s") for i, x in enumerate(AWKWARD)]
    rows += [(100, clean, "de", "s"), (101, clean, None, None), (100, clean, "de", "s"), (None, clean + " Ende", "de", "s")]
    docs = documents(rows).withColumnRenamed("n_chars", "score")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, ""), name)
        if name == "drop_near_duplicates":
            assert sum(r.doc_id in (100, 101) for r in docs.collect()) == 1
    assert {r.doc_id for r in docs.collect()} <= {100, None} | {r.doc_id for r in before.collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, before.limit(0), "").count() == 0


def test_texts_of_no_known_language_go(spark, documents):
    """Letters that no learned text has are no language; short and mixed texts stay."""
    rows = [(i, x, y, "s") for i, (x, y) in enumerate([
        ("the cat sat on the mat with another cat", "en"), ("der Hund liegt auf der Matte", "de")] * 20)]
    probes = ["Привет мир как дела", "καλημέρα κόσμε", "漢字 かな", "cat", "the Hund", "cats и собаки", "Ω 漢字 the"]
    rows += [(100 + i, x, None, "s") for i, x in enumerate(probes)]
    kept = corpus_pipeline.identify_language(spark, documents(rows), "").collect()
    assert {probes[r.doc_id - 100] for r in kept if r.doc_id >= 100} == set(probes[3:])
    assert sum(r.doc_id < 100 for r in kept) == 40


def test_repeated_ids_and_columns_of_any_name(spark, documents):
    """Unlike texts of one id all stay, copies go, and other columns keep their values in every stage."""
    def text(k):
        return " ".join(f"Wort{chr(97 + (i * k) % 26)}{chr(97 + i // 26)}{k}a{i}" for i in range(80))

    rows = [(1, text(2), "de", "s"), (1, text(3), "de", "s"), (2, text(4), "de", "s"), (2, text(4), "de", "s"),
            (3, text(4), "de", "s"), (1, text(5), "de", "s"), (1, text(5), "de", "s")]
    names = ["rate", "shift", "_k", "_start", "_first", "score", "size", "kept", "n_words", "failed", "component_id", "lang_pred",
             "_rest", "_node", "copies", "target", "component_root", "_nth", "a.b"]
    docs = documents(rows)
    for name in names:
        docs = docs.withColumn(name, corpus_pipeline.F.concat(corpus_pipeline.F.lit(name), "doc_id"))
    for stage, function in corpus_pipeline.STAGES[:-1]:
        docs = written(function(spark, docs, ""), stage)
        for r in docs.collect():
            assert all(r[name] == f"{name}{r.doc_id}" for name in names), stage
        if stage == "drop_near_duplicates":
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted({(1, text(2)), (1, text(3)), (2, text(4)), (1, text(5))})


def test_texts_of_single_ids_are_not_dealt_by_component(spark, documents):
    text = "one two three four five six seven eight"
    single = documents([(i, f"{text} {i // 2}", "en", "s") for i in range(20)])
    left = corpus_pipeline.drop_near_duplicates(spark, single, "")
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 20, 2))
    # Before, every text was dealt and sorted by its component.
    assert sum(exchanged(left._jdf.queryExecution().executedPlan(), "component_root")) == 0
    repeated = single.unionByName(single.filter("doc_id < 6")).unionByName(documents([(None, text, "en", "s")]))
    left = corpus_pipeline.drop_near_duplicates(spark, repeated, "")
    assert sorted((r.doc_id is None, r.doc_id) for r in left.collect()) == [(False, i) for i in range(0, 20, 2)] + [(True, None)]
