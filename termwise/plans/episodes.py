"""Program episodes: every row of one student in one program, as one row.

An episode is keyed by (student_id, u_g, degtype). One shuffle on that key
gathers its bounds and its distinct (term, attributes) entries, combined before
the shuffle, so a key that holds a large share of the rows still arrives as a
handful of entries. Persistence at later terms is then read off the entries,
with no join back to enrollment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwise.functions.scalars import joined_key
from termwise.functions.terms import term_season, term_year
from termwise.plans.staging import calendar_terms

EPISODE_KEY = ["student_id", "u_g", "degtype"]


def with_cohort_flag(enrollment: DataFrame) -> DataFrame:
    """Mark each row that lies in its episode's first term.

    The first term is aggregated per key and joined back, not taken over a
    window, so that no task has to hold all rows of one key. Rows with a NULL in
    the key belong together, as they do in a window.
    """
    first = enrollment.groupBy(*[F.col(c).alias(f"_{c}") for c in EPISODE_KEY]).agg(F.min("term_code").alias("_first"))
    same = F.lit(True)
    for c in EPISODE_KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return enrollment.join(first, same).selectExpr(
        *enrollment.columns, "CASE WHEN term_code = _first THEN 1 ELSE 0 END AS is_cohort_term_row")


def check_terms(calendar: DataFrame) -> DataFrame:
    """Per entry term, the terms 1, 2 and 4 major terms later.

    A hop is a join with the calendar, so it is only taken from a term that is
    itself in the data: a later hop is NULL once a term in between is missing.
    """
    terms = calendar_terms(calendar)

    def hop(at: str, to: str) -> DataFrame:
        return F.broadcast(terms.selectExpr(f"current_term AS {at}", f"next_major_term AS {to}"))

    return (
        terms.selectExpr("current_term AS cohort_term", "next_major_term AS next_term")
        .join(hop("next_term", "one_year_term"), "next_term", "left")
        .join(hop("one_year_term", "_third"), "one_year_term", "left")
        .join(hop("_third", "two_year_term"), "_third", "left")
        .select("cohort_term", "next_term", "one_year_term", "two_year_term")
    )


def check_term_table(calendar: DataFrame) -> DataFrame:
    """The complete chains only, under their reported names."""
    return check_terms(calendar).filter("two_year_term IS NOT NULL").selectExpr(
        "cohort_term", "one_year_term AS one_year_check_term", "two_year_term AS two_year_check_term")


def keyed_rows(enrollment: DataFrame) -> DataFrame:
    """Rows that belong to an episode: no NULL in the key."""
    return enrollment.filter(" AND ".join(f"{key} IS NOT NULL" for key in EPISODE_KEY))


def entry_terms(enrollment: DataFrame) -> DataFrame:
    """The entry term of each episode and nothing else."""
    return keyed_rows(enrollment).groupBy(*EPISODE_KEY).agg(F.min("term_code").alias("cohort_term")).filter(
        "cohort_term IS NOT NULL")


def program_entries(enrollment: DataFrame) -> DataFrame:
    """The distinct entries of every key, keys with a NULL among them: what episodes and term moves are read off."""
    return enrollment.groupBy(*EPISODE_KEY).agg(F.expr("""
        collect_set(struct(term_code, school, pell, firstgen, gender,
                           coalesce(regstat_code = '1', false) AS first_time,
                           coalesce(academic_state = 'Graduated', false) AS graduated)) AS entries"""))


def episode_bounds(enrollment: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Entry and last term, outcome, and attributes at entry; one row per key.

    Attributes are the greatest value among the rows of the entry term. ``entries``
    are the rows' `program_entries` where they are stored.
    """
    # The bounds are read off the gathered entries: one aggregate is cheaper to
    # combine than the entries and five more.
    gathered = program_entries(keyed_rows(enrollment)) if entries is None else keyed_rows(entries)
    at_entry = gathered.selectExpr(
        *EPISODE_KEY,
        "entries.term_code AS terms",
        "array_min(entries.term_code) AS cohort_term",
        "array_max(entries.term_code) AS last_term",
        "CASE WHEN exists(entries, e -> e.first_time) THEN 1 ELSE 0 END AS is_first_time_cohort",
        "filter(entries, e -> e.graduated).term_code AS graduations",
        "entries",
    ).filter("cohort_term IS NOT NULL").selectExpr(
        *EPISODE_KEY, "terms", "cohort_term", "last_term", "is_first_time_cohort",
        "CASE WHEN size(graduations) > 0 THEN 1 ELSE 0 END AS graduated_flag",
        "array_min(graduations) AS graduation_term",
        "filter(entries, e -> e.term_code = cohort_term) AS first",
    )
    return at_entry.select(
        joined_key(*EPISODE_KEY, "cohort_term").alias("program_episode_id"),
        *EPISODE_KEY,
        "cohort_term",
        term_year("cohort_term").alias("cohort_year"),
        term_season("cohort_term").alias("cohort_season"),
        *[F.expr(f"array_max(first.{name}) AS cohort_{name}") for name in ("school", "pell", "firstgen", "gender")],
        "last_term",
        "is_first_time_cohort",
        "graduated_flag",
        "graduation_term",
        "terms",
    )


EPISODE_COLUMNS = [
    "program_episode_id", "student_id", "u_g", "degtype", "cohort_term", "cohort_year", "cohort_season",
    "cohort_school", "cohort_pell", "cohort_firstgen", "cohort_gender", "last_term", "is_first_time_cohort",
    "graduated_flag", "graduation_term", "enrolled_next_term", "retained_one_year", "retained_two_year",
    "graduated_before_one_year_mark", "graduated_before_two_year_mark",
]


def int_program_episodes(enrollment: DataFrame, calendar: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Episodes with their persistence and early-completion flags.

    The early-completion marks need the whole four-hop chain: where it breaks,
    both are 0, also the one-year mark.
    """
    marks = episode_bounds(enrollment, entries).join(F.broadcast(check_terms(calendar)), "cohort_term", "left")
    flags = {
        "enrolled_next_term": "array_contains(terms, next_term)",
        "retained_one_year": "array_contains(terms, one_year_term)",
        "retained_two_year": "array_contains(terms, two_year_term)",
        "graduated_before_one_year_mark": "two_year_term IS NOT NULL AND graduation_term <= one_year_term",
        "graduated_before_two_year_mark": "graduation_term <= two_year_term",
    }
    return marks.selectExpr(
        *[c for c in EPISODE_COLUMNS if c not in flags],
        *[f"CASE WHEN {condition} THEN 1 ELSE 0 END AS {name}" for name, condition in flags.items()])


def dim_program_episode(episodes: DataFrame) -> DataFrame:
    """Attributes for slicing only; outcome flags are left out on purpose."""
    return episodes.selectExpr(
        "program_episode_id", "student_id", "u_g", "degtype", "cohort_term", "cohort_year", "cohort_season",
        "cohort_school AS school", "cohort_pell AS pell", "cohort_firstgen AS firstgen", "cohort_gender AS gender",
        "last_term", "is_first_time_cohort")
