"""Message windows over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Messages kept as history, and as context for a follow-up.
HISTORY_MESSAGES = 20
CONTEXT_MESSAGES = 6


def last_messages(messages: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """The latest ``n`` messages of each conversation.

    The rank filter is applied within each partition before the shuffle, so a
    conversation of any length sends at most ``n`` rows per partition.
    """
    newest_first = W.partitionBy("conv_id").orderBy(F.col("turn").desc(), F.col("role").desc(), F.col("text").desc())
    return messages.withColumn("_rank", F.row_number().over(newest_first)).filter(F.col("_rank") <= n).drop("_rank")


def api_roles(messages: DataFrame) -> DataFrame:
    """Roles as the answering side names them: ``user``, and ``model`` for all else."""
    return messages.withColumn("role", F.when(F.col("role") == "user", "user").otherwise("model"))


def recent_transcript(messages: DataFrame, n: int = CONTEXT_MESSAGES) -> DataFrame:
    """One row per conversation: its last messages as ``role: text`` lines."""
    lines = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return last_messages(messages, n).groupBy("conv_id").agg(
        F.array_join(F.transform(lines, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
        .alias("transcript"),
        F.count(F.lit(1)).alias("n_messages"),
    )


def with_context(questions: DataFrame, messages: DataFrame, n: int = CONTEXT_MESSAGES) -> DataFrame:
    """Put the recent transcript before each question; no history leaves it unchanged."""
    joined = questions.join(recent_transcript(messages, n), "conv_id", "left")
    return joined.withColumn(
        "question_in_context",
        F.when(F.col("transcript").isNull(), F.col("question")).otherwise(
            F.concat(F.lit("Said before:\n"), F.col("transcript"),
                     F.lit("\n\nNow asked: "), F.col("question"))),
    ).drop("transcript", "n_messages")
