"""Route questions, anchor them in time and tell which want a chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwise.functions import phrases


def current_term(enrollment: DataFrame) -> DataFrame:
    """One row: the latest term in the data, whatever the clock says."""
    return enrollment.agg(F.max("term_code").alias("current_term"))


def route_questions(questions: DataFrame, has_documents: bool | Column = False) -> DataFrame:
    loaded = F.lit(has_documents) if isinstance(has_documents, bool) else has_documents
    return questions.withColumn("route", phrases.route(F.col("question"), loaded))


def resolve_terms(questions: DataFrame, enrollment: DataFrame) -> DataFrame:
    """Append the meaning of relative phrases; the latest term is a scalar subquery."""
    latest = current_term(enrollment).scalar()
    return (
        questions.withColumn("_now", latest)
        .withColumn("resolved", phrases.resolve_relative_terms(F.col("question"), "_now"))
        .drop("_now")
    )


def chart_intent(questions: DataFrame) -> DataFrame:
    return questions.withColumn("wants_chart", phrases.wants_chart(F.col("question")))
