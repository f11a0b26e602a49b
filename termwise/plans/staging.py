"""Cleaned, typed and decoded enrollment, and the calendar of major terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwise.functions.scalars import blank_to_unknown, to_gpa, to_integer
from termwise.functions.terms import is_major_term, next_major_term, term_season, term_year
from termwise.sources import seeds


def typed_enrollment(landing: DataFrame) -> DataFrame:
    """The staged columns that need no lookup: narrow, no shuffle, no broadcast."""
    return landing.select(
        "student_id",
        "u_g",
        "gender",
        "school",
        "degtype",
        blank_to_unknown("firstgen").alias("firstgen"),
        blank_to_unknown("pell").alias("pell"),
        F.expr("ethnicmultirace AS ethnicity_code"),
        F.expr("citizen AS citizen_code"),
        to_integer("creditenr").alias("creditenr"),
        to_gpa("accumgpa").alias("accumgpa"),
        "academic_state",
        F.expr("regstat AS regstat_code"),
        "term_code",
        term_year("term_code").alias("term_year"),
        term_season("term_code").alias("term_season"),
    )


def cast_rejects(landing: DataFrame) -> DataFrame:
    """One row: how many filled values became NULL in the casts."""
    return landing.agg(
        F.count_if(F.col("creditenr").isNotNull() & to_integer("creditenr").isNull()).alias("creditenr_rejects"),
        F.count_if(F.col("accumgpa").isNotNull() & to_gpa("accumgpa").isNull()).alias("accumgpa_rejects"),
    )


def decode_codes(enrollment: DataFrame) -> DataFrame:
    """Add the four descriptions by broadcast left joins; an unknown code stays NULL."""
    spark = enrollment.sparkSession
    lookups = (
        (seeds.school_codes(spark), "school_code", "school"),
        (seeds.citizen_codes(spark), "citizen_code", "citizen_code"),
        (seeds.regstat_codes(spark), "regstat_code", "regstat_code"),
        (seeds.ethnicity_codes(spark), "ethnicity_code", "ethnicity_code"),
    )
    out = enrollment
    for seed, code, column in lookups:
        described = seed.selectExpr(f"CAST({code} AS STRING) AS {column}", seed.columns[1])
        out = out.join(F.broadcast(described), column, "left")
    return out


STG_COLUMNS = [
    "student_id", "u_g", "gender", "school", "school_name", "degtype", "firstgen", "pell",
    "ethnicity_code", "ethnicity_description", "citizen_code", "citizen_description",
    "creditenr", "accumgpa", "academic_state", "regstat_code", "regstat_description",
    "term_code", "term_year", "term_season",
]


def stg_student_enrollment(landing: DataFrame) -> DataFrame:
    return described_enrollment(typed_enrollment(landing))


def described_enrollment(typed: DataFrame) -> DataFrame:
    """Typed rows with their descriptions, as the staged table has them."""
    return decode_codes(typed).select(*STG_COLUMNS)


def stg_term_calendar(enrollment: DataFrame) -> DataFrame:
    """Each code present in the data that ends like a Fall or Spring term, and the major term after it."""
    return enrollment.filter(is_major_term("term_code")).select(F.expr("term_code AS current_term")).distinct().select(
        "current_term", next_major_term("current_term").alias("next_major_term"))


def calendar_terms(calendar: DataFrame) -> DataFrame:
    """The codes of a calendar that are terms: four digits and a suffix, so at most 20,000 rows to broadcast."""
    return calendar.filter("current_term RLIKE '^[0-9]{6}$'")


def calendar_rejects(calendar: DataFrame) -> DataFrame:
    """One row: how many codes end like a major term without being one. No other term leads to such a code."""
    return calendar.agg(F.count_if(F.expr("NOT current_term RLIKE '^[0-9]{6}$'")).alias("odd_codes"))
