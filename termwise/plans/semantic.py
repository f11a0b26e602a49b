"""Semantic models over the report tables and the catalogue of named metrics.

A rate is always re-derived from summed numerators and denominators at the
grouping asked for; stored rates are never averaged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwise.functions.scalars import joined_key, pct
from termwise.functions.terms import cohort_start_date, term_start_date, term_year_sql

FULL_TIME_CREDITS = 12


@dataclass(frozen=True)
class SemanticModel:
    name: str
    table: str
    entity: str
    entity_parts: tuple[str, ...]
    dimensions: tuple[str, ...]
    measures: tuple[str, ...]
    time_dimension: str
    time_grain: str
    # Whether the measure counts distinct students, which cannot be summed.
    distinct: bool = False

    def entity_key(self) -> Column:
        return joined_key(*self.entity_parts).alias(self.entity)

    def time_column(self) -> Column:
        if self.time_dimension == "cohort_start_date":
            return cohort_start_date("cohort_year")
        if "current_term" in self.dimensions:
            return term_start_date(term_year_sql("current_term"), "right(current_term, 2) = '10'")
        return term_start_date("term_year", "term_season = 'Spring'")


_COHORT_DIMS = ("cohort_year", "degtype", "u_g", "gender", "school", "pell")
_COHORT_KEY = ("degtype", "u_g", "gender", "school", "pell", "cohort_year")

MODELS = {
    m.name: m
    for m in (
        SemanticModel("graduation_rate", "fct_graduation_rate", "graduation_rate_grouping", _COHORT_KEY,
                      _COHORT_DIMS, ("cohort_size", "graduated_count"), "cohort_start_date", "year"),
        SemanticModel("retention_rate_cohort", "fct_retention_rate_cohort", "retention_rate_grouping", _COHORT_KEY,
                      _COHORT_DIMS,
                      ("one_year_eligible_cohort_size", "one_year_retained_count",
                       "two_year_eligible_cohort_size", "two_year_retained_count"),
                      "cohort_start_date", "year"),
        SemanticModel("retention_rate_term", "fct_retention_rate_term", "term_retention_grouping",
                      ("current_term", "degtype", "u_g", "school"),
                      ("current_term", "degtype", "u_g", "school"),
                      ("prior_students", "graduates_excluded", "eligible_prior_students", "continuing_students"),
                      "term_start_date", "month"),
        SemanticModel("enrollment_by_semester_level", "fct_enrollment_term", "program_episode_term",
                      ("program_episode_id", "term_code"),
                      ("term_code", "term_year", "term_season", "u_g", "school", "pell"),
                      ("student_count",), "term_start_date", "month", distinct=True),
    )
}


def student_heads(enrollment: DataFrame, by: list[str], flags: dict[str, str]) -> DataFrame:
    """Distinct students per group, in all and with each flag (a SQL condition).

    Rows are first combined per student, before the shuffle, so that a student
    or a group with a large share of the rows costs no more than any other, and
    several distinct counts need no copy of the rows each.
    """
    students = enrollment.filter("student_id IS NOT NULL")
    if not flags:
        per_student = students.select(*by, "student_id").distinct()
    else:
        per_student = students.groupBy(*by, "student_id").agg(
            *[F.expr(f"max(CASE WHEN {c} THEN 1 ELSE 0 END) AS {name}") for name, c in flags.items()])
    return per_student.groupBy(*by).agg(
        F.expr("count(*) AS student_count"), *[F.expr(f"sum({name}) AS {name}") for name in flags])


Measures = Callable[[DataFrame, list[str]], DataFrame]


def _sums(*names: str) -> Measures:
    return lambda df, by: df.groupBy(*by).agg(*[F.expr(f"CAST(sum({n}) AS BIGINT) AS {n}") for n in names])


def model_measures(model: SemanticModel, table: DataFrame, by: list[str]) -> DataFrame:
    """Every measure of a model at a grouping of its dimensions."""
    return (student_heads(table, by, {}) if model.distinct else _sums(*model.measures)(table, by))


def measures_over_time(model: SemanticModel, table: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """Measures per period of the model's time dimension; with a spine, also the empty periods."""
    period = F.trunc(model.time_column(), model.time_grain)
    found = model_measures(model, table.withColumn("period", period), ["period"])
    if spine is None:
        return found
    # Periods of the data that lie outside of the spine are periods too.
    periods = spine.select(F.trunc("date_day", model.time_grain).alias("period")).unionByName(
        found.select("period").filter("period IS NOT NULL")).distinct()
    return periods.join(found, "period", "left")


_FLAGS = {
    "pell_students": "pell = 'Y'",
    "full_time": f"creditenr >= {FULL_TIME_CREDITS}",
    "part_time": f"creditenr < {FULL_TIME_CREDITS}",
    "first_generation": "firstgen = 'Y'",
}


def _heads(*flags: str) -> Measures:
    return lambda df, by: student_heads(df, by, {f: _FLAGS[f] for f in flags})


def _mean(column: str, scale: int) -> Measures:
    return lambda df, by: df.groupBy(*by).agg(
        F.expr(f"CAST(round(avg(CAST({column} AS DECIMAL(10,2))), {scale}) AS DOUBLE) AS mean"))


def _count(only_first_time: bool) -> Measures:
    def run(df: DataFrame, by: list[str]) -> DataFrame:
        rows = df.filter("is_first_time_cohort = 1") if only_first_time else df
        return rows.groupBy(*by).agg(F.expr("count(*) AS n"))

    return run


def _pell_rates(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[
        F.expr(f"CAST(sum(CASE WHEN pell = '{value}' THEN {column} END) AS BIGINT) AS {value}_{column}")
        for value in ("N", "Y") for column in ("graduated_count", "cohort_size")])


@dataclass(frozen=True)
class Metric:
    """A measure, or an expression over measures, on one report table."""

    table: str
    measures: Measures
    value: Callable[[], Column]


def _plain(table: str, measures: Measures, value: str) -> Metric:
    return Metric(table, measures, lambda: F.expr(value))


def _sum(table: str, name: str) -> Metric:
    return _plain(table, _sums(name), name)


def _rate(table: str, top: str, bottom: str) -> Metric:
    return Metric(table, _sums(top, bottom), lambda: pct(top, bottom))


_GRAD, _RETC = "fct_graduation_rate", "fct_retention_rate_cohort"
_RETT, _GRADT = "fct_retention_rate_term", "fct_graduation_rate_term"
_ENR, _DIM = "fct_enrollment_term", "dim_program_episode"

METRICS: dict[str, Metric] = {
    "cohort_size": _sum(_GRAD, "cohort_size"),
    "graduated_count": _sum(_GRAD, "graduated_count"),
    "graduation_rate": _rate(_GRAD, "graduated_count", "cohort_size"),
    "one_year_eligible_cohort_size": _sum(_RETC, "one_year_eligible_cohort_size"),
    "one_year_retained_count": _sum(_RETC, "one_year_retained_count"),
    "first_year_retention_rate": _rate(_RETC, "one_year_retained_count", "one_year_eligible_cohort_size"),
    "two_year_eligible_cohort_size": _sum(_RETC, "two_year_eligible_cohort_size"),
    "two_year_retained_count": _sum(_RETC, "two_year_retained_count"),
    "second_year_retention_rate": _rate(_RETC, "two_year_retained_count", "two_year_eligible_cohort_size"),
    "non_graduation_rate": Metric(_GRAD, _sums("cohort_size", "graduated_count"),
                                  lambda: pct("(cohort_size - graduated_count)", "cohort_size")),
    "students_not_graduated": _plain(_GRAD, _sums("cohort_size", "graduated_count"),
                                     "cohort_size - graduated_count"),
    "pell_graduation_gap": Metric(
        _GRAD, _pell_rates,
        lambda: F.round(pct("N_graduated_count", "N_cohort_size") - pct("Y_graduated_count", "Y_cohort_size"), 4)),
    "student_count": _plain(_ENR, _heads(), "student_count"),
    "pell_student_count": _plain(_ENR, _heads("pell_students"), "pell_students"),
    "pell_enrollment_rate": Metric(_ENR, _heads("pell_students"),
                                   lambda: pct("pell_students", "student_count", 2)),
    "adjusted_retention_rate": _rate(_RETT, "continuing_students", "eligible_prior_students"),
    "attrition_rate": Metric(
        _RETT, _sums("eligible_prior_students", "continuing_students"),
        lambda: pct("(eligible_prior_students - continuing_students)", "eligible_prior_students")),
    "prior_students": _sum(_RETT, "prior_students"),
    "continuing_students": _sum(_RETT, "continuing_students"),
    "graduates_excluded": _sum(_RETT, "graduates_excluded"),
    "eligible_prior_students": _sum(_RETT, "eligible_prior_students"),
    "term_graduation_rate": _rate(_GRADT, "graduated_students", "prior_students"),
    "term_graduated_students": _sum(_GRADT, "graduated_students"),
    "avg_gpa": _plain(_ENR, _mean("accumgpa", 2), "mean"),
    "avg_credits": _plain(_ENR, _mean("creditenr", 1), "mean"),
    "full_time_students": _plain(_ENR, _heads("full_time"), "full_time"),
    "part_time_students": _plain(_ENR, _heads("part_time"), "part_time"),
    "full_time_rate": Metric(_ENR, _heads("full_time"), lambda: pct("full_time", "student_count", 2)),
    "firstgen_enrollment_count": _plain(_ENR, _heads("first_generation"), "first_generation"),
    "total_unique_students_ever": _plain(_ENR, _heads(), "student_count"),
    "new_program_starts": _plain(_DIM, _count(True), "n"),
    "first_time_student_count": _plain(_DIM, _count(True), "n"),
    "total_program_episodes": _plain(_DIM, _count(False), "n"),
}


def metric(name: str, tables: Mapping[str, DataFrame], by: list[str] | None = None,
           where: str | Column | None = None) -> DataFrame:
    """One named metric at any grouping, optionally over a filtered table."""
    by = list(by or [])
    m = METRICS[name]
    table = tables[m.table]
    if m.table == _ENR:
        table = _with_episode(table, tables, [*by, *(re.findall(r"\w+", where) if isinstance(where, str) else [])])
    if where is not None:
        table = table.filter(where)
    return m.measures(table, by).select(*by, m.value().alias(name))


def _with_episode(fact: DataFrame, tables: Mapping[str, DataFrame], wanted: list[str]) -> DataFrame:
    """The enrollment fact with the episode attributes asked for that it lacks, such as gender.

    One episode has one row per term, so no key is hot.
    """
    lacking = [c for c in dict.fromkeys(wanted) if c not in fact.columns]
    if not lacking:
        return fact
    episodes = tables[_DIM]
    lacking = [c for c in lacking if c in episodes.columns]
    return fact.join(episodes.select("program_episode_id", *lacking), "program_episode_id") if lacking else fact


def subset_rate(fact: DataFrame, by: list[str], top: str, bottom: str, name: str, scale: int = 4,
                top_as: str | None = None, bottom_as: str | None = None) -> DataFrame:
    """A rate at any subset of a report table's dimensions, with both its sums."""
    return fact.groupBy(*by).agg(
        F.expr(f"sum({bottom}) AS {bottom_as or bottom}"), F.expr(f"sum({top}) AS {top_as or top}"),
        pct(f"sum({top})", f"sum({bottom})", scale).alias(name))


def weighted_rate(fact: DataFrame, by: list[str], rate: str, weight: str, name: str, scale: int = 2) -> DataFrame:
    """The stored rate weighted back by its denominator; rows without a rate weigh nothing."""
    total = f"sum(CAST({rate} AS DECIMAL(20,4)) * {weight})"
    return fact.groupBy(*by).agg(
        F.expr(f"CAST(round({total} / nullif(sum({weight}), 0), {scale}) AS DOUBLE) AS {name}"))


def rate_cube(fact: DataFrame, dims: list[str], top: str, bottom: str, name: str) -> DataFrame:
    """A rate at every subset of ``dims`` in one pass, from the sums and never from stored rates.

    ``grouping_id`` has a bit for each dimension left out, the first one's highest.
    """
    sums = fact.groupBy(*dims).agg(F.sum(top).alias(top), F.sum(bottom).alias(bottom))
    return sums.cube(*dims).agg(
        F.grouping_id().alias("grouping_id"), F.sum(top).alias(top), F.sum(bottom).alias(bottom)
    ).withColumn(name, pct(top, bottom))
