"""Declared tests over built tables, counted as failing rows or groups."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwise.operators.quality import ACADEMIC_STATES, LEVELS, SCHOOLS, duplicate_groups


def null_rows(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def rows_outside_values(column: str, allowed) -> Column:
    """NULL passes."""
    return F.count_if(~F.col(column).isin(*allowed))


def rows_outside_range(column: str, low, high) -> Column:
    """Inclusive bounds; NULL passes."""
    return F.count_if((F.col(column) < low) | (F.col(column) > high))


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """One row: how many non-NULL values occur more than once."""
    return duplicate_groups(df.filter(F.col(column).isNotNull()), [column])


@dataclass(frozen=True)
class DataTest:
    model: str
    test: str
    columns: tuple[str, ...]
    values: tuple = field(default=())

    @property
    def label(self) -> str:
        return ", ".join(self.columns)


def _t(model, test, *columns, values=()):
    return DataTest(model, test, tuple(columns), tuple(values))


PELL_VALUES = ("Y", "N", "Unknown")
COHORT_GRAIN = ("degtype", "u_g", "gender", "school", "pell", "cohort_year")

# The declared tests.
DECLARED_TESTS = (
    _t("stg_student_enrollment", "not_null", "student_id"),
    _t("stg_student_enrollment", "not_null", "u_g"),
    _t("stg_student_enrollment", "accepted_values", "u_g", values=LEVELS),
    _t("stg_student_enrollment", "accepted_values", "school", values=SCHOOLS),
    _t("stg_student_enrollment", "not_null", "term_code"),
    _t("stg_student_enrollment", "accepted_values", "pell", values=PELL_VALUES),
    _t("stg_student_enrollment", "accepted_values", "firstgen", values=PELL_VALUES),
    _t("stg_student_enrollment", "accepted_values", "academic_state", values=ACADEMIC_STATES),
    _t("stg_student_enrollment", "unique_combination", "student_id", "u_g", "degtype", "term_code"),
    _t("stg_term_calendar", "not_null", "current_term"),
    _t("stg_term_calendar", "unique", "current_term"),
    _t("stg_term_calendar", "not_null", "next_major_term"),
    _t("int_program_episodes", "not_null", "program_episode_id"),
    _t("int_program_episodes", "unique", "program_episode_id"),
    _t("int_program_episodes", "not_null", "student_id"),
    _t("int_program_episodes", "not_null", "cohort_term"),
    _t("int_program_episodes", "accepted_values", "is_first_time_cohort", values=(0, 1)),
    _t("int_program_episodes", "accepted_values", "graduated_flag", values=(0, 1)),
    _t("int_program_episodes", "accepted_values", "retained_one_year", values=(0, 1)),
    _t("int_program_episodes", "accepted_values", "retained_two_year", values=(0, 1)),
    _t("int_program_episodes", "unique_combination", "student_id", "u_g", "degtype"),
    _t("fct_graduation_rate_term", "not_null", "current_term"),
    _t("fct_graduation_rate_term", "accepted_range", "term_graduation_rate_pct", values=(0, 100)),
    _t("fct_graduation_rate_term", "unique_combination",
       "current_term", "degtype", "u_g", "gender", "school", "pell"),
    _t("fct_retention_rate_term", "not_null", "current_term"),
    _t("fct_retention_rate_term", "accepted_range", "adjusted_retention_rate", values=(0, 100)),
    _t("fct_retention_rate_term", "accepted_range", "attrition_rate_pct", values=(0, 100)),
    _t("fct_retention_rate_term", "unique_combination", "current_term", "degtype", "u_g", "school"),
    _t("dim_program_episode", "not_null", "program_episode_id"),
    _t("dim_program_episode", "unique", "program_episode_id"),
    _t("fct_enrollment_term", "not_null", "student_id"),
    _t("fct_enrollment_term", "not_null", "term_code"),
    _t("fct_enrollment_term", "accepted_values", "u_g", values=LEVELS),
    _t("fct_enrollment_term", "accepted_values", "pell", values=PELL_VALUES),
    _t("fct_enrollment_term", "unique_combination", "program_episode_id", "term_code"),
    _t("fct_retention_rate_cohort", "accepted_values", "u_g", values=LEVELS),
    _t("fct_retention_rate_cohort", "accepted_values", "pell", values=PELL_VALUES),
    _t("fct_retention_rate_cohort", "accepted_range", "first_year_retention_rate_pct", values=(0, 100)),
    _t("fct_retention_rate_cohort", "accepted_range", "second_year_retention_rate_pct", values=(0, 100)),
    _t("fct_retention_rate_cohort", "unique_combination", *COHORT_GRAIN),
    _t("fct_graduation_rate", "accepted_values", "u_g", values=LEVELS),
    _t("fct_graduation_rate", "accepted_values", "pell", values=PELL_VALUES),
    _t("fct_graduation_rate", "accepted_range", "graduation_rate_pct", values=(0, 100)),
    _t("fct_graduation_rate", "unique_combination", *COHORT_GRAIN),
    _t("fct_graduation_rate", "expression_is_true", "cohort_year", values=(2,)),
)


def _row_level(test: DataTest, tables: dict[str, DataFrame]) -> Column:
    column = test.columns[0]
    if test.test == "not_null":
        return null_rows(column)
    if test.test == "accepted_values":
        return rows_outside_values(column, test.values)
    if test.test == "accepted_range":
        return rows_outside_range(column, *test.values)
    # expression_is_true: no cohort younger than the given number of years.
    newest = tables["int_program_episodes"].agg(F.max("cohort_year")).scalar()
    return F.count_if(~F.coalesce(F.col(column) <= newest - test.values[0], F.lit(False)))


def run_tests(tables: dict[str, DataFrame], tests=DECLARED_TESTS) -> DataFrame:
    """(model, test, column_name, failures): one pass per table for all row tests,
    and one grouping per uniqueness test. Zero failures is a pass."""
    parts = []
    for model in dict.fromkeys(t.model for t in tests):
        df = tables[model]
        by_row = [t for t in tests if t.model == model and not t.test.startswith("unique")]
        if by_row:
            counts = df.agg(*[_row_level(t, tables).cast("bigint").alias(f"t{i}") for i, t in enumerate(by_row)])
            parts.append(counts.select(F.inline(F.array(*[
                F.struct(F.lit(t.model).alias("model"), F.lit(t.test).alias("test"),
                         F.lit(t.label).alias("column_name"), F.col(f"t{i}").alias("failures"))
                for i, t in enumerate(by_row)]))))
        for t in tests:
            if t.model != model or not t.test.startswith("unique"):
                continue
            found = repeated_values(df, t.columns[0]) if t.test == "unique" else duplicate_groups(df, list(t.columns))
            parts.append(found.select(F.lit(t.model).alias("model"), F.lit(t.test).alias("test"),
                                      F.lit(t.label).alias("column_name"), F.col("value").alias("failures")))
    return reduce(DataFrame.unionByName, parts)
