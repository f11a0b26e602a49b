import pytest

TOKENIZERS = "/opt/tokenizers"

AWKWARD = [
    None, "", " ", "\n", "  ", "a", "A b", "don't 's 're it's", " leading", "trailing ", "two  spaces\n\n new  \n lines \t tab\r\n",
    "tabs\tand no-break line 　wide", "\x1c\x1f control \x85 next", "ünïcödé 漢字 かな 한국어 🎉🎊 ́combining é",
    "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoftext|>", "<unk> <s> </s> <0x41><unk>é☃<unk>", "▁under ▁▁ bars▁",
    "123456 3.14 1e10 ½ Ⅷ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 300, "ab" * 2000, "word " * 3000, "☃" * 50,
    "Ω ω ς ΣΑΣ İI ıi ß ẞ", "mixed Case MIXED cASE", "a" * 30000,
]


@pytest.fixture
def documents(spark):
    """A documents frame from texts, or from (doc_id, text, lang, source) rows."""

    def make(rows, partitions=3):
        rows = [r if isinstance(r, tuple) else (i, r, "en", f"src{i % 3}") for i, r in enumerate(rows)]
        rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(partitions)

    return make
