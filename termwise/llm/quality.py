"""Quality rules as a ledger of failure bits and measurements.

Every rule is looked at once per document. The ledger keeps what was measured
and one bit for each rule that failed; a policy is a mask over those bits, so a
verdict, another version of a policy, or the effect of leaving a rule out needs
no second look at the texts.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words, fails
``few_words`` and nothing else. Each row is judged on its own, so equal rows
get equal verdicts; a null id is carried through.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwise.llm.texts import as_bytes, with_arrays

# A rule's place is its bit; new rules go to the end, so older ledgers stay readable.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
}
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length"),
}
POLICY = 2

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"

_BREAKS = b" \t\n\r\x0b\x0c"
_NOT_CHARS = _BREAKS + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    covered, reach = 0, 0
    for at, window in enumerate(windows):
        if found[window] > 1:
            covered += at + 3 - max(reach, at)
            reach = at + 3
    return covered


def measure_text(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _NOT_CHARS)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measure(texts: pa.Array) -> list[pa.Array]:
    rows = [measure_text(x) for x in as_bytes(texts)]
    return [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * 6


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with measurements and ``failed``, one bit per rule of ``RULES`` that failed.

    ``keep`` names the columns of ``docs`` to return, by default all.
    """
    measured = with_arrays(docs, MEASURES, _measure, keep)
    bits = [F.when(F.expr(rule), F.lit(1 << at)).otherwise(F.lit(0)) for at, rule in enumerate(RULES.values())]
    return measured.withColumn("failed", sum(bits[1:], bits[0]).cast("long"))


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(x) for x in rules)


def apply_policy(rows: DataFrame, policy: int = POLICY, name: str = "kept") -> DataFrame:
    """Adds the verdict of a policy: none of its rules failed."""
    return rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablations(rows: DataFrame, policy: int = POLICY) -> DataFrame:
    """(rule, n_failed, n_only, n_kept, n_kept_without) for each rule of a policy.

    ``n_only`` documents fail this rule alone: they are what leaving it out would keep.
    """
    whole = mask(POLICIES[policy])
    hits = F.col("failed").bitwiseAND(F.lit(whole))
    # One pass: counts per distinct set of failures, at most two to the power of the rules.
    sets = rows.groupBy(hits.alias("hits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(mask([x])).cast("long").alias("bit"))
                                for x in POLICIES[policy]]))
    return (
        sets.select("hits", "n", rules.alias("r")).select("hits", "n", "r.rule", "r.bit")
        .groupBy("rule").agg(
            F.sum(F.when(F.col("hits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("hits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("hits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        )
        .withColumn("n_kept_without", F.col("n_kept") + F.col("n_only"))
    )
