"""Documents to training tokens: five stages, each one of the corpus operators.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. Models learn from the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termwise.llm import bpe, langid, mixing, neardup, quality
from termwise.llm.registry import BYTE_BPE
from termwise.llm.texts import packed, remainder, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language can be told go; a missing language is filled in.

    None can be told where less than ``langid.LEAST`` of a text's letters is in words that
    share a word, or letters in a row, with those learned. A text that is only short or mixed
    stays, whatever the score of its language.
    """
    model = langid.fit(docs.filter(remainder("doc_id", 4) != 2))
    frame, unpack = packed(docs, ["text", "lang"])
    found = langid.predict(frame, model, least=langid.LEAST).filter(F.col("lang_pred") != langid.UNDECIDED)
    return unpack(found.withColumn("lang", F.coalesce("lang", "lang_pred")))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail a rule of the current policy go."""
    frame, unpack = packed(docs, ["text"])
    return unpack(quality.apply_policy(quality.ledger(frame)).filter("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Of rows that share that id and are in the group too, the one whose text has the
    least hash stays. Rows without an id or a word are in no group and stay.
    """
    frame, unpack = packed(docs, ["doc_id", "text"])
    kept = neardup.near_duplicates(frame, root=True).filter("kept")
    # Texts are compared only where an id stands for several rows; those of all other rows stay out of this shuffle.
    grouped = kept.filter("component_root IS NOT NULL")
    several = written(grouped.groupBy("component_root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                      .select("component_root"), "several")
    first = F.row_number().over(Window.partitionBy("component_root").orderBy(F.xxhash64("text"), "text"))
    chosen = grouped.join(several, "component_root", "left_semi").withColumn("_nth", first).filter("_nth = 1")
    return unpack(chosen).unionByName(unpack(kept.join(several, "component_root", "left_anti")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says."""
    frame, unpack = packed(docs, ["doc_id", "source", "text"])
    return unpack(mixing.emit_copies(mixing.mix(mixing.with_size(frame))))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, same): the ids, and whether they decode to the text."""
    rules = bpe.automaton(BYTE_BPE)
    return bpe.round_trip(docs, rules, ["doc_id", "lang", "source", "text"]).select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


STAGES = [
    ("identify_language", identify_language),
    ("apply_quality_rules", apply_quality_rules),
    ("drop_near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("encode_and_decode", encode_and_decode),
]

# Neither the language model nor the encoding can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
