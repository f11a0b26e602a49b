"""The sample questions, each answered from a report table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwise.functions.scalars import pct
from termwise.plans.semantic import student_heads, subset_rate

DEFAULT_LIMIT = 50
ANSWER_ROWS = 20

# (numerator, denominator, their names in the answer, the rate's name)
GRADUATED = ("graduated_count", "cohort_size", "graduated_count", "cohort_size", "graduation_rate_pct")
KEPT_ONE_YEAR = ("one_year_retained_count", "one_year_eligible_cohort_size", "retained", "eligible",
                 "first_year_retention_rate_pct")
KEPT_TWO_YEARS = ("two_year_retained_count", "two_year_eligible_cohort_size", "retained", "eligible",
                  "second_year_retention_rate_pct")


def limited(df: DataFrame, *order, n: int = DEFAULT_LIMIT) -> DataFrame:
    """A result cut to the default number of rows, after a total order."""
    return df.orderBy(*order).limit(n)


def answer_rows(df: DataFrame, *order) -> DataFrame:
    """The first rows of a result, as many as an answer text is written from."""
    return limited(df, *order, n=ANSWER_ROWS)


def in_order(few: DataFrame, *order) -> DataFrame:
    """The few finished rows of an answer in order, without first sampling them for ranges."""
    return few.repartition(1).sortWithinPartitions(*order)


def cohort_rate(fact: DataFrame, where: str, by: str, what: tuple[str, ...]) -> DataFrame:
    top, bottom, top_as, bottom_as, name = what
    return subset_rate(fact.filter(where), [by], top, bottom, name, 2, top_as, bottom_as)


def best_rate(fact: DataFrame, where: str, what: tuple[str, ...]) -> DataFrame:
    """The entry year with the highest rate; years nobody was judged in cannot win."""
    rates = cohort_rate(fact, where, "cohort_year", what)
    return rates.filter(F.col(what[3]) > 0).orderBy(F.col(what[4]).desc_nulls_last(), "cohort_year").limit(1)


def pell_graduation_trend(grad: DataFrame) -> DataFrame:
    return in_order(cohort_rate(grad, "pell = 'Y'", "cohort_year", GRADUATED), "cohort_year")


def first_year_retention(retention: DataFrame, level: str, school: str) -> DataFrame:
    what = (*KEPT_ONE_YEAR[:3], "eligible_cohort", KEPT_ONE_YEAR[4])
    return in_order(cohort_rate(retention, f"u_g = '{level}' AND school = '{school}'", "cohort_year", what), "cohort_year")


def headcount(enrollment: DataFrame, where: str, by: list[str], name: str) -> DataFrame:
    return in_order(student_heads(enrollment.filter(where), by, {}).withColumnRenamed("student_count", name), by[0])


def graduation_by_school(grad: DataFrame, cohort_year: int) -> DataFrame:
    return in_order(cohort_rate(grad, f"cohort_year = {cohort_year}", "school", GRADUATED),
                    F.col("graduation_rate_pct").desc_nulls_last(), "school")


def two_year_retention(retention: DataFrame, level: str, gender: str) -> DataFrame:
    return in_order(cohort_rate(retention, f"u_g = '{level}' AND gender = '{gender}'", "cohort_year", KEPT_TWO_YEARS),
                    "cohort_year")


def term_attrition(retention_term: DataFrame, term: str, level: str) -> DataFrame:
    return retention_term.filter(f"current_term = '{term}' AND u_g = '{level}'").groupBy("current_term").agg(
        F.expr("sum(prior_students) AS prior_students"),
        F.expr("sum(graduates_excluded) AS graduates_excluded"),
        F.expr("sum(eligible_prior_students) AS eligible_prior"),
        F.expr("sum(continuing_students) AS continuing"),
        pct("(sum(eligible_prior_students) - sum(continuing_students))", "sum(eligible_prior_students)", 2)
        .alias("attrition_rate_pct"))


def program_starts(dim: DataFrame, level: str, school: str, cohort_year: int) -> DataFrame:
    return dim.filter(
        f"u_g = '{level}' AND school = '{school}' AND cohort_year = {cohort_year} AND is_first_time_cohort = 1"
    ).agg(F.expr("count(*) AS new_phd_students"))


def average_gpa(enrollment: DataFrame, school: str, pell: str, term: str) -> DataFrame:
    return enrollment.filter(f"school = '{school}' AND pell = '{pell}' AND term_code = '{term}'").agg(
        F.expr("CAST(round(avg(accumgpa), 2) AS DOUBLE) AS avg_gpa"))


def graduates_in_term(graduation_term: DataFrame, term: str) -> DataFrame:
    return graduation_term.filter(f"current_term = '{term}'").agg(
        F.expr("sum(graduated_students) AS total_graduates"))


def pell_gap(grad: DataFrame) -> DataFrame:
    return in_order(cohort_rate(grad, "pell IN ('Y', 'N')", "pell", GRADUATED), "pell")


def risk_by_school(risk: DataFrame) -> DataFrame:
    """Mean dropout probability of the scored students; graduates are not scored."""
    exact = "CAST(dropout_probability AS DECIMAL(12,9))"
    return risk.filter("risk_flag IS NOT NULL").groupBy("school").agg(
        F.expr("count(*) AS scored_students"),
        F.expr(f"CAST(round(sum({exact}) / count(dropout_probability), 6) AS DOUBLE) AS avg_dropout_probability"))


def risk_counts(risk: DataFrame) -> DataFrame:
    at_risk = "count_if(risk_flag = 'YES')"
    return risk.agg(
        F.expr("count(*) AS students"),
        F.expr("count(risk_flag) AS scored_students"),
        F.expr(f"{at_risk} AS at_risk_students"),
        pct(at_risk, "count(risk_flag)", 2).alias("at_risk_pct"),
        pct("count(risk_flag)", "count(*)", 2).alias("scored_pct"))


def risk_join_enrollment(risk: DataFrame, enrollment: DataFrame) -> DataFrame:
    """Enrolled students at their scored term, by term and flag.

    The snapshot's term is a number, enrollment's is text. Enrollment is reduced
    to one row per student and term first, so no student weighs on the join.
    """
    seen = enrollment.select("student_id", "term_code").distinct()
    scored = risk.selectExpr("student_id", "risk_flag", "CAST(term_code AS STRING) AS term_code")
    return seen.join(scored, ["student_id", "term_code"]).groupBy("term_code", "risk_flag").agg(
        F.expr("count(student_id) AS students"))


def headcount_of_members(enrollment: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct students per term among the members, by a semi join.

    Each student's terms are gathered before the join, so both sides arrive with
    one row per student, already partitioned by student.
    """
    terms = enrollment.groupBy("student_id").agg(F.expr("collect_set(term_code) AS terms"))
    return terms.join(members.select("student_id").distinct(), "student_id", "left_semi").selectExpr(
        "explode(terms) AS term_code").groupBy("term_code").agg(F.expr("count(*) AS student_count"))
