import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termwise.operators import documents
from termwise.operators.documents import text_cutter
from termwise.sources.chunk_store import ChunkStore


def test_short_text_is_one_chunk():
    assert text_cutter()("  hello world ") == ["hello world"]
    assert text_cutter()("   ") == []


def test_paragraphs_pack_up_to_the_size():
    cut = text_cutter(size=18, overlap=0)
    assert cut("aaaa bbbb\n\ncccc dddd\n\neeee ffff") == ["aaaa bbbb", "cccc dddd", "eeee ffff"]
    assert cut("aaaa\n\nbbbb\n\ncccc dddd eeee") == ["aaaa\n\nbbbb", "cccc dddd eeee"]


def test_overlap_repeats_whole_pieces():
    assert text_cutter(size=11, overlap=4)("aaa bbb ccc ddd eee") == ["aaa bbb ccc", "ccc ddd", "ddd eee"]


def test_long_piece_is_cut_by_the_next_separator():
    cut = text_cutter(size=10, overlap=0)
    assert cut("aaa\n\nbbbb cccc dddd") == ["aaa", "bbbb cccc", "dddd"]


def test_unbroken_run_may_exceed_the_size():
    assert text_cutter(size=10, overlap=0)("x" * 25) == ["x" * 25]


PARTS = st.lists(st.sampled_from(["w", "ww", "www", "w" * 15, " ", "  ", "\n", "\n\n", ". "]), max_size=120)


@given(PARTS, st.integers(8, 30), st.integers(0, 7))
@settings(max_examples=300, deadline=None)
def test_chunk_invariants(parts, size, overlap):
    # Every letter is a character of its own, so where a chunk came from is certain.
    letters = itertools.count(0x4E00)
    text = re.sub("w", lambda _: chr(next(letters)), "".join(parts))
    covered = 0x4E00
    for chunk in text_cutter(size, overlap)(text):
        assert chunk and chunk == chunk.strip() and chunk in text
        inner = chunk[1:].rstrip()
        assert len(chunk) <= size or not re.search(r"\n|\. | ", inner)
        codes = [ord(c) for c in chunk if ord(c) >= 0x4E00]
        if codes:
            # In order, no gap, and no more repeated than the overlap allows.
            assert codes == list(range(codes[0], codes[-1] + 1))
            assert codes[0] <= covered <= codes[-1] + 1 and covered - codes[0] <= overlap
            covered = codes[-1] + 1
    assert covered == next(letters)


def test_chunk_table(spark):
    df = spark.createDataFrame([("a.b.txt", "x" * 5), ("plain", ""), (".hidden", "y"), ("dir/c.md", None)],
                               "source string, text string")
    got = sorted(tuple(r) for r in documents.chunk_documents(df).collect())
    assert got == [(".hidden", 0, ".hidden_0", "y"), ("a.b.txt", 0, "a.b_0", "xxxxx")]


def test_chunks_number_from_zero(spark):
    df = spark.createDataFrame([("s", " ".join(["word"] * 500))], "source string, text string")
    got = sorted((r["chunk"], len(r["text"])) for r in documents.chunk_documents(df).collect())
    assert [c for c, _ in got] == list(range(len(got))) and all(n <= 800 for _, n in got) and len(got) > 2


def test_upsert(spark, rows):
    stored = spark.createDataFrame([("a", 0, "old"), ("a", 1, "old"), ("b", 0, "keep")],
                                   "source string, chunk int, text string")
    loaded = spark.createDataFrame([("a", 0, "new"), ("c", 0, "new")], stored.schema)
    assert rows(documents.upsert_chunks(stored, loaded)) == [
        ("a", 0, "new"), ("b", 0, "keep"), ("c", 0, "new")]


def test_embedding_hook(spark):
    def make_encoder():
        return lambda texts: [[len(t), 1] for t in texts]

    chunks = spark.createDataFrame([("a", 0, "abc")], "source string, chunk int, text string")
    assert documents.embed_chunks(chunks, make_encoder).first()["embedding"] == [3.0, 1.0]


def test_sources_in_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "source string")
    assert [tuple(r) for r in documents.list_sources(df).collect()] == [("a", 1), ("b", 2)]


def store_rows(store):
    return sorted((r.source, r.chunk, r.text) for r in store.read().collect())


@pytest.mark.parametrize("buckets", [1, 4])
def test_store_replaces_sources(spark, tmp_path, buckets):
    store = ChunkStore(spark, str(tmp_path / "chunks"), buckets)
    many = " ".join(["word"] * 400)

    def load(*docs):
        store.load_documents(spark.createDataFrame(docs, "source string, text string"))

    load(("a.txt", many), ("b.txt", "one"), ("dir/a.txt", "two"))
    first = store_rows(store)
    assert [r[:2] for r in first] == [("a.txt", 0), ("a.txt", 1), ("a.txt", 2), ("b.txt", 0), ("dir/a.txt", 0)]
    load(("a.txt", many), ("b.txt", "one"), ("dir/a.txt", "two"))
    assert store_rows(store) == first
    # Shorter now: its later chunks go. An empty and a NULL text leave what is there.
    load(("a.txt", "short"), ("b.txt", " "), ("dir/a.txt", None), ("c.txt", "new"))
    assert store_rows(store) == [("a.txt", 0, "short"), ("b.txt", 0, "one"), ("c.txt", 0, "new"), ("dir/a.txt", 0, "two")]
    assert [tuple(r) for r in store.sources().collect()] == [("a.txt", 1), ("b.txt", 1), ("c.txt", 1), ("dir/a.txt", 1)]
    assert store.chunk_count().first()[0] == 4
    store.load_documents(spark.createDataFrame([], "source string, text string"))
    assert store.chunk_count().first()[0] == 4


def test_store_rewrites_only_touched_folders(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"), 8)
    store.load_documents(spark.createDataFrame([(f"s{i}", f"text {i}") for i in range(40)], "source string, text string"))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "chunks").rglob("*.parquet")}
    store.load_documents(spark.createDataFrame([("s7", "other")], "source string, text string"))
    after = set((tmp_path / "chunks").rglob("*.parquet"))
    assert len({p.parent for p in set(before) - after}) == 1 and len({p.parent for p in before}) > 4
    assert dict((r[0], r[2]) for r in store_rows(store))["s7"] == "other" and store.chunk_count().first()[0] == 40


def test_hashing_encoder_is_kept_by_name_and_feeds_retrieval(spark):
    from termwise.operators.retrieval import retrieve_topk

    texts = ["the cat sat", "a dog ran", "the cat sat down", ""]
    vectors = documents.hashing_encoder(32)(texts)
    assert all(len(v) == 32 for v in vectors) and sum(map(abs, vectors[0])) == 3 and not any(vectors[3])
    chunks = spark.createDataFrame([(str(i), 0, x) for i, x in enumerate(texts)], "source string, chunk int, text string")
    embedded = documents.embed_chunks(chunks, lambda: documents.hashing_encoder(32), "hashing-32")
    got = {r.source: list(r.embedding) for r in embedded.collect()}
    assert [got[str(i)] for i in range(4)] == vectors
    asked = embedded.filter("source = '0'").selectExpr("source AS query_id", "embedding")
    near = retrieve_topk(embedded.selectExpr("source AS item_id", "embedding"), asked).orderBy("rank").collect()
    assert [r.item_id for r in near[:2]] == ["0", "2"]


def test_text_files_with_path_and_time(spark, tmp_path):
    from termwise.sources.layers import text_documents

    for i in range(50):
        (tmp_path / f"f{i}.txt").write_text(f"text {i}\n\nmore")
    files = text_documents(spark, str(tmp_path), with_file=True)
    assert files.rdd.getNumPartitions() < 25
    rows = files.collect()
    assert sorted(r.source for r in rows) == sorted(f"f{i}.txt" for i in range(50))
    assert all(r.path.endswith("/" + r.source) and r.modified.timestamp() > 0 for r in rows)


def test_packed_text_files_give_every_text_back(spark, tmp_path):
    from termwise.sources.layers import packed_documents, write_text_documents

    texts = ["", "one", "a\n\nb\r\nc\r", "\n", "~", "~0~1~~", "x\x1ey\x1e", "\u00e9\u2028 \U0001f600", "\ufeffz", "12\n34"]
    docs = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(texts)] + [("none", None)], "source string, text string")
    write_text_documents(docs.coalesce(2), str(tmp_path / "t"))
    # Before, as many files as documents.
    assert len(list((tmp_path / "t").glob("part-*"))) <= 2
    rows = packed_documents(spark, str(tmp_path / "t")).collect()
    assert {r.source: r.text for r in rows} == {f"s{i}": x + "\n" for i, x in enumerate(texts)} and len(rows) == len(texts)
    assert all(r.path and r.modified.timestamp() > 0 for r in rows)


def test_load_text_files_writes_few_files(spark, tmp_path, monkeypatch):
    from termwise.checks import queries

    (tmp_path / "in").mkdir()
    spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1).write.parquet(
        str(tmp_path / "in" / "documents.parquet"))
    monkeypatch.setattr(queries, "scratch_path", lambda _, label: str(tmp_path / label))
    loaded = queries.QUERIES["load_text_files"](spark, str(tmp_path / "in"))
    assert sorted((r.source, r.text) for r in loaded.collect()) == sorted((str(i), f"text {i}") for i in range(200))
    # Before, a folder and a file for each of the 200.
    assert sum(1 for f in (tmp_path / "text-files").rglob("part-*")) <= 8
