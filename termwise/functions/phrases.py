"""Phrase rules on question text: routing, relative time and chart intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termwise.functions.terms import previous_major_term_sql, term_season_sql, term_year_sql

# Phrases that point at the data.
DATA_PHRASES = (
    "graduation rate", "retention rate", "attrition", "enrollment",
    "how many students", "number of students", "pell", "cohort",
    "school", "college", "engineering", "computing", "management",
    "undergrad", "graduate", "master", "doctoral", "phd",
    "semester", "term", "fall", "spring", "2015", "2016", "2017",
    "2018", "2019", "2020", "2021", "2022", "2023", "2024",
    "gpa", "credits", "full-time", "part-time", "firstgen",
    "first generation", "first-gen", "female", "male", "gender", "degree",
    "completed", "dropped", "trend", "average", "percentage", "rate",
    "count", "total", "compare", "which school", "highest", "lowest",
    "arr", "adjusted retention", "dropout", "at risk", "risk score",
    "prediction", "stop out", "stopout", "readmit",
    "continuing students", "prior students",
    "pell gap", "equity gap",
    "term over term", "term-over-term",
    "cohort year", "matured cohort",
    "two year", "2-year", "one year", "1-year",
    "plot", "chart", "graph", "visualize", "visualise",
    "u_g", "degtype",
)
# Phrases that point at a loaded document.
DOCUMENT_PHRASES = (
    "what does the brief say", "according to the report", "in the document",
    "what is the assignment", "explain the methodology", "round 1",
    "the pdf", "the report", "assumption", "formula defined",
    "the file", "the document", "this scenario", "the scenario",
    "uploaded", "summarize", "summarise", "the upload",
    "mentioned in", "described in", "in the pdf", "in the file",
)
# Relative-time phrases (case-insensitive).
LAST_YEAR = r"\b(last|past)\s+year\b"
THIS_YEAR = r"\b(this|current)\s+year\b"
LAST_TERM = r"\b(last|previous)\s+(semester|term)\b"
THIS_TERM = r"\b(this|current)\s+(semester|term)\b"
PAST_YEARS = r"\bpast\s+(\d+)\s+years?\b"
RECENT = r"\brecent(ly)?\b"
# Chart wording (case-insensitive).
CHART_VERB = r"\b(plot|chart|graph|visuali[sz]e)\b"
CHART_TREND = (
    r"\btrend(s)?\b.*\b(over time|by year|by term|by semester|by cohort)\b"
    r"|\b(over time|by year|by term|by semester|by cohort)\b.*\btrend(s)?\b"
)
NOT_A_CHART = (
    r"\bdata lineage\b|\bdependency graph\b|\bgraph database\b|\bknowledge graph\b"
    r"|\bwhat (is|does|are)\b.*\b(chart|graph)\b.*\b(mean|measure)\b"
)

# Case-insensitive, with word and space classes for every script.
_FLAGS = "(?iUd)"


def _found(question: Column, pattern: str) -> Column:
    return question.rlike(_FLAGS + pattern)


def mentions_any(question: Column, phrases) -> Column:
    """Plain substring tests on the lower-cased text, as intended ('male' is in 'female')."""
    return F.lower(question).rlike("|".join(rf"\Q{p}\E" for p in phrases))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def route(question: Column, has_documents: Column) -> Column:
    """``both``, ``rag``, ``sql`` or ``clarify`` for one question."""
    data, document = mentions_any(question, DATA_PHRASES), mentions_any(question, DOCUMENT_PHRASES)
    return (
        F.when(data & document, "both")
        .when(document, "rag")
        .when(data, "sql")
        .when(word_count(question) <= 3, "clarify")
        .when(has_documents, "rag")
        .otherwise("sql")
    )


def wants_chart(question: Column) -> Column:
    asked = _found(question, CHART_VERB) | _found(question, CHART_TREND)
    return asked & ~_found(question, NOT_A_CHART)


def resolve_relative_terms(question: Column, current: str) -> Column:
    """Append what each relative phrase means, given the column of the latest term.

    The question itself is never changed; each kind is appended at most once and
    always in the same order.
    """
    year = term_year_sql(current)
    previous = f"coalesce({previous_major_term_sql(current)}, {current})"

    def named(term: str) -> str:
        return f"{term_season_sql(term, 'Unknown')} || ' ' || {term_year_sql(term)}"

    span = F.regexp_extract(question, _FLAGS + PAST_YEARS, 1).try_cast("decimal(38,0)")
    first = (F.expr(year) - span).cast("decimal(38,0)").cast("string")
    notes = [
        F.when(_found(question, LAST_YEAR), F.expr(f"'(most recent cohort_year: ' || ({year} - 1) || ')'")),
        F.when(_found(question, THIS_YEAR), F.expr(f"'(current cohort_year: ' || {year} || ')'")),
        F.when(_found(question, LAST_TERM),
               F.expr(f"'(previous major term: ' || {previous} || ', ' || {named(previous)} || ')'")),
        F.when(_found(question, THIS_TERM),
               F.expr(f"'(current term: ' || {current} || ', ' || {named(current)} || ')'")),
        F.when(_found(question, PAST_YEARS),
               F.concat(F.lit("(cohort_years "), first, F.expr(f"'-' || {year} || ')'"))),
        F.when(_found(question, RECENT),
               F.expr(f"'(data available through: ' || {current} || ', ' || {named(current)} || ')'")),
    ]
    return F.concat_ws(" ", question, *notes)
