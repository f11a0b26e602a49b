"""Report tables: enrollment by term, cohort rates and term-over-term rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwise.functions.scalars import pct
from termwise.functions.terms import is_major_term_sql, next_major_term_sql
from termwise.plans.episodes import EPISODE_KEY, keyed_rows
from termwise.plans.staging import calendar_terms

# Years in YYYYTT units a level needs before a cohort is judged.
MATURITY_WINDOWS = {"U": 400, "G": 200, "D": 500}
ONE_YEAR, TWO_YEARS = 100, 200
MATURITY_SQL = "CASE u_g " + " ".join(f"WHEN '{u}' THEN {n}" for u, n in MATURITY_WINDOWS.items()) + " END"
# The entry term as a number; a malformed code never counts as matured.
ENTERED = "try_cast(cohort_term AS INT)"


def enrollment_rows(enrollment: DataFrame) -> DataFrame:
    """The rows of the enrollment fact, without the columns taken from the episode.

    Every keyed row has exactly one episode, so a question that needs no episode
    column needs no join.
    """
    return keyed_rows(enrollment)


def fct_enrollment_term(enrollment: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episode by term, each row carrying its episode id and entry term.

    One equi-join on the episode key. An episode is one row, so where a key holds
    a large share of the rows, adaptive execution splits the left side only.
    """
    wanted = [c for c in enrollment.columns
              if c not in ("gender", "ethnicity_code", "citizen_code", "regstat_code")]
    right = episodes.select(*EPISODE_KEY, "program_episode_id", "cohort_term", "is_first_time_cohort")
    return enrollment_rows(enrollment).select(*wanted).join(right, EPISODE_KEY)


COHORT_DIMS = ["degtype", "u_g", "gender", "school", "pell", "cohort_year"]


def _cohorts(episodes: DataFrame) -> DataFrame:
    return episodes.withColumnsRenamed(
        {"cohort_gender": "gender", "cohort_school": "school", "cohort_pell": "pell"}
    )


def newest_cohort(entries: DataFrame) -> Column:
    """The latest entry term of any episode, as a scalar subquery.

    ``entries`` is any frame of entry terms. Stored episodes do; where episodes
    are still a plan, `entry_terms` saves working them out a second time.
    """
    return entries.agg(F.expr(f"max({ENTERED})")).scalar()


def matured_cohorts(episodes: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """First-time episodes whose level has had its full time to graduate."""
    return episodes.filter("is_first_time_cohort = 1").filter(
        F.expr(f"{ENTERED} + {MATURITY_SQL}") <= newest_cohort(episodes if entries is None else entries))


def _cohort_counts(episodes: DataFrame, **sums: str) -> DataFrame:
    """Sums over first-time episodes per entry term and attributes, beside the newest entry term of any episode.

    The episodes are read once: their counts, as few as there are entry terms and
    attributes, also hold the newest term.
    """
    first_time = "is_first_time_cohort = 1"
    counted = _cohorts(episodes).groupBy(*COHORT_DIMS, "cohort_term").agg(
        F.expr(f"count_if({first_time}) AS cohort_size"),
        *[F.expr(f"sum(CASE WHEN {first_time} THEN {value} ELSE 0 END) AS {name}") for name, value in sums.items()])
    return counted.withColumn("newest", F.expr(f"max({ENTERED}) OVER ()")).filter("cohort_size > 0")


def fct_graduation_rate(episodes: DataFrame) -> DataFrame:
    matured = _cohort_counts(episodes, graduated="graduated_flag").filter(f"{ENTERED} + {MATURITY_SQL} <= newest")
    return matured.groupBy(*COHORT_DIMS).agg(
        F.expr("sum(cohort_size) AS cohort_size"),
        F.expr("sum(graduated) AS graduated_count"),
        pct("sum(graduated)", "sum(cohort_size)").alias("graduation_rate_pct"),
    )


def fct_retention_rate_cohort(episodes: DataFrame) -> DataFrame:
    """One- and two-year retention; a cohort too young keeps its row with a NULL rate."""
    one_open, two_open = "graduated_before_one_year_mark = 0", "graduated_before_two_year_mark = 0"
    judged = _cohort_counts(
        episodes, one=f"CAST({one_open} AS INT)", kept_one=f"CASE WHEN {one_open} THEN retained_one_year ELSE 0 END",
        two=f"CAST({two_open} AS INT)", kept_two=f"CASE WHEN {two_open} THEN retained_two_year ELSE 0 END")
    one, two = f"{ENTERED} + {ONE_YEAR} <= newest", f"{ENTERED} + {TWO_YEARS} <= newest"
    sums = judged.groupBy(*COHORT_DIMS).agg(
        F.expr(f"sum(CASE WHEN {one} THEN one ELSE 0 END) AS one_year_eligible_cohort_size"),
        F.expr(f"sum(CASE WHEN {one} THEN kept_one ELSE 0 END) AS one_year_retained_count"),
        F.expr(f"sum(CASE WHEN {two} THEN two ELSE 0 END) AS two_year_eligible_cohort_size"),
        F.expr(f"sum(CASE WHEN {two} THEN kept_two ELSE 0 END) AS two_year_retained_count"),
    )
    return sums.select(
        *COHORT_DIMS,
        "one_year_eligible_cohort_size",
        "one_year_retained_count",
        pct("one_year_retained_count", "one_year_eligible_cohort_size").alias("first_year_retention_rate_pct"),
        "two_year_eligible_cohort_size",
        "two_year_retained_count",
        pct("two_year_retained_count", "two_year_eligible_cohort_size").alias("second_year_retention_rate_pct"),
    )


def term_moves(enrollment: DataFrame, calendar: DataFrame, dims: list[str],
               entries: DataFrame | None = None) -> DataFrame:
    """One row per student, program, prior-term attributes and following major term.

    ``continued`` says the same episode is enrolled in the current term;
    ``graduated`` that it graduated from the prior term on and before the current
    one. Attributes are those of the prior term. Entries are gathered once per
    episode key, or read as ``entries``, the rows' `program_entries`. Moves are told
    apart within a key's entries, so they need no shuffle of their own. Both flags
    are 0 where the key or an attribute is NULL, as such rows find no partner under
    plain equality.
    """
    listed = ", ".join(dims)
    known = " AND ".join([*(f"{c} IS NOT NULL" for c in EPISODE_KEY), *(f"m.{d} IS NOT NULL" for d in dims)])
    gathered = enrollment.groupBy(*EPISODE_KEY).agg(F.expr(
        f"collect_set(struct(term_code, {listed}, coalesce(academic_state = 'Graduated', false) AS graduated))"
        " AS entries")) if entries is None else entries
    # Listed before the explode, so once per key and not once per prior term.
    attributes = ", ".join(f"e.{d} AS {d}" for d in dims)
    listed_once = gathered.selectExpr(
        *EPISODE_KEY, "entries.term_code AS terms", "filter(entries, e -> e.graduated).term_code AS graduations",
        f"transform(filter(entries, e -> {is_major_term_sql('e.term_code')}), e -> struct("
        f"{next_major_term_sql('e.term_code')} AS current_term, {attributes}, e.term_code AS prior_term)) AS prior")
    # Entries that differ in nothing else are one move; it has several prior terms only where codes are malformed.
    same = " AND ".join(f"p.{c} <=> m.{c}" for c in ["current_term", *dims])
    kept = ", ".join(f"p.{c} AS {c}" for c in ["current_term", *dims])
    found = ", ".join(f"m.{c} AS {c}" for c in ["current_term", *dims])
    flagged = listed_once.selectExpr(*EPISODE_KEY, f"""explode(transform(
        array_distinct(transform(prior, p -> struct({kept}))),
        m -> struct({found},
            CASE WHEN {known} AND array_contains(terms, m.current_term) THEN 1 ELSE 0 END AS continued,
            CASE WHEN {known} AND size(graduations) > 0 AND exists(prior, p -> {same} AND exists(
                graduations, g -> g >= p.prior_term AND g < m.current_term)) THEN 1 ELSE 0 END AS graduated))) AS move""")
    moves = flagged.select("move.current_term", *EPISODE_KEY, *[f"move.{x}" for x in [*dims, "continued", "graduated"]])
    return moves.join(F.broadcast(calendar_terms(calendar).select("current_term")), "current_term", "left_semi")


def _term_counts(moves: DataFrame, dims: list[str]) -> DataFrame:
    return moves.groupBy("current_term", "degtype", "u_g", *dims).agg(
        F.expr("count(student_id) AS prior_students"),
        F.expr("sum(graduated) AS graduates"),
        F.expr("sum(continued) AS continuing_students"),
    )


def graduates_between_terms(enrollment: DataFrame, calendar: DataFrame) -> DataFrame:
    """Students who graduated from the prior term on and before the current one."""
    return term_moves(enrollment, calendar, ["school"]).filter("graduated = 1").groupBy(
        "current_term", "degtype", "u_g", "school").agg(F.expr("count(student_id) AS graduates_excluded"))


def continuing_students(enrollment: DataFrame, calendar: DataFrame) -> DataFrame:
    """Students enrolled in the same program in the prior and the current term."""
    return term_moves(enrollment, calendar, ["school"]).filter("continued = 1").groupBy(
        "current_term", "degtype", "u_g", "school").agg(F.expr("count(student_id) AS continuing_students"))


def fct_graduation_rate_term(enrollment: DataFrame, calendar: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    dims = ["gender", "school", "pell"]
    counts = _term_counts(term_moves(enrollment, calendar, dims, entries), dims)
    return counts.select(
        "current_term", "degtype", "u_g", *dims, "prior_students",
        F.expr("graduates AS graduated_students"),
        pct("graduates", "prior_students").alias("term_graduation_rate_pct"),
    )


def fct_retention_rate_term(enrollment: DataFrame, calendar: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Continuing over prior less graduates, and its complement.

    A graduate who comes back counts on both sides, so a rate may exceed 100.
    """
    counts = _term_counts(term_moves(enrollment, calendar, ["school"], entries), ["school"]).selectExpr(
        "*", "prior_students - graduates AS eligible_prior_students")
    return counts.select(
        "current_term", "degtype", "u_g", "school", "prior_students",
        F.expr("graduates AS graduates_excluded"),
        "eligible_prior_students",
        "continuing_students",
        pct("continuing_students", "eligible_prior_students").alias("adjusted_retention_rate"),
        pct("(eligible_prior_students - continuing_students)", "eligible_prior_students").alias("attrition_rate_pct"),
    )


def graduation_term_eligible(episodes: DataFrame, calendar: DataFrame) -> DataFrame:
    """Term graduation rate over everyone due to graduate, as documented.

    A first-time episode is due from the first term at which its level's window
    has passed, and stays due in every major term until it graduates. Episodes
    are first counted per entry term, graduation term and attributes; only those
    counts, whose number depends on the code lists and not on the rows, are
    spread over the calendar.
    """
    dims = ["degtype", "u_g", "gender", "school", "pell"]
    counted = _cohorts(episodes.filter("is_first_time_cohort = 1")).groupBy(
        *dims, "cohort_term", "graduation_term").agg(F.expr("count(*) AS n"))
    terms = calendar_terms(calendar).agg(F.expr("sort_array(collect_set(current_term))")).scalar()
    due = counted.withColumn("terms", terms).selectExpr(
        *dims, "graduation_term", "n", f"{ENTERED} + {MATURITY_SQL} AS due_from", "terms"
    ).selectExpr(
        *dims, "graduation_term", "n",
        "explode(filter(terms, t -> try_cast(t AS INT) >= due_from"
        " AND (graduation_term IS NULL OR t <= graduation_term))) AS current_term")
    done = "sum(CASE WHEN graduation_term = current_term THEN n ELSE 0 END)"
    return due.groupBy("current_term", *dims).agg(
        F.expr("sum(n) AS eligible_students"),
        F.expr(f"{done} AS graduated_students"),
        pct(done, "sum(n)").alias("term_graduation_rate_pct"),
    )
