"""Rates, casts and keys used across the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(numerator: str, denominator: str, scale: int = 4) -> Column:
    """``round(100 * numerator / denominator, scale)``; NULL over a zero denominator.

    Both are SQL expressions. The quotient is decimal, so halves round the same
    way on every engine; only the finished rate becomes a double.
    """
    return F.expr(
        f"CAST(round(CAST(100 AS DECIMAL(5,1)) * CAST({numerator} AS DECIMAL(20,0)) "
        f"/ nullif(CAST({denominator} AS DECIMAL(20,0)), CAST(0 AS DECIMAL(20,0))), {scale}) AS DOUBLE)")


def blank_to_unknown(value: str) -> Column:
    """Blank or NULL becomes ``Unknown``; anything else is returned untrimmed."""
    return F.expr(f"CASE WHEN nullif(trim({value}), '') IS NULL THEN 'Unknown' ELSE {value} END")


def to_integer(value: str) -> Column:
    """Text to integer, rounding halves away from zero; NULL if it is no number."""
    return F.expr(f"try_cast(round(try_cast({value} AS DECIMAL(28,8)), 0) AS INT)")


def to_gpa(value: str) -> Column:
    return F.expr(f"try_cast({value} AS DECIMAL(4,2))")


def joined_key(*parts: str) -> Column:
    """Parts joined by ``-``; NULL as soon as one part is NULL."""
    return F.expr(" || '-' || ".join(f"CAST({part} AS STRING)" for part in parts))


def is_number_text(value: str | Column) -> Column:
    """Whether text reads as a plain number (sign, point and exponent allowed)."""
    return (F.col(value) if isinstance(value, str) else value).rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
