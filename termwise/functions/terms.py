"""Term codes: ``YYYYTT`` strings that sort in calendar order.

Fall (90) and Spring (10) are the major terms; Summer (50) and Winter (95)
never take part in term sequencing. Each rule is given as SQL text over any
expression, for use inside larger expressions, and as a column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Term suffixes and their season names.
SEASONS = {"10": "Spring", "50": "Summer", "90": "Fall", "95": "Winter"}
MAJOR_SUFFIXES = ("10", "90")


def term_year_sql(term: str) -> str:
    return f"try_cast(substring({term}, 1, 4) AS INT)"


def term_season_sql(term: str, unknown: str | None = None) -> str:
    """Season name; ``unknown`` is NULL in tables and a label in annotations."""
    cases = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in SEASONS.items())
    other = "CAST(NULL AS STRING)" if unknown is None else f"'{unknown}'"
    return f"CASE right({term}, 2) {cases} ELSE {other} END"


def is_major_term_sql(term: str) -> str:
    return f"right({term}, 2) IN ('{MAJOR_SUFFIXES[0]}', '{MAJOR_SUFFIXES[1]}')"


def next_major_term_sql(term: str) -> str:
    return (f"CASE right({term}, 2) WHEN '90' THEN CAST({term_year_sql(term)} + 1 AS STRING) || '10' "
            f"WHEN '10' THEN substring({term}, 1, 4) || '90' END")


def previous_major_term_sql(term: str) -> str:
    return (f"CASE right({term}, 2) WHEN '10' THEN CAST({term_year_sql(term)} - 1 AS STRING) || '90' "
            f"WHEN '90' THEN substring({term}, 1, 4) || '10' END")


def term_year(term: str) -> Column:
    return F.expr(term_year_sql(term))


def term_season(term: str, unknown: str | None = None) -> Column:
    return F.expr(term_season_sql(term, unknown))


def is_major_term(term: str) -> Column:
    return F.expr(is_major_term_sql(term))


def next_major_term(term: str) -> Column:
    return F.expr(next_major_term_sql(term))


def previous_major_term(term: str) -> Column:
    return F.expr(previous_major_term_sql(term))


def shift_year(term: str, years: int) -> Column:
    """The same season a number of years later, or earlier when negative."""
    return F.expr(f"CAST({term_year_sql(term)} + ({years}) AS STRING) || substring({term}, 5)")


def shift_year_number(term: str, years: int) -> Column:
    """The same shift on the numeric form of the code: 100 per year."""
    return F.expr(f"{term} + ({100 * years})")


def cohort_start_date(year: str) -> Column:
    return F.expr(f"make_date({year}, 9, 1)")


def term_start_date(year: str, is_spring: str) -> Column:
    """1 January for Spring, else 1 September; Summer therefore counts as September."""
    return F.expr(f"make_date({year}, CASE WHEN {is_spring} THEN 1 ELSE 9 END, 1)")
