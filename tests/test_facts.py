"""Term facts on the edge rows, and relations that must hold between tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from termwise.checks.queries import Tables
from termwise.plans import facts
from termwise.plans.episodes import program_entries
from termwise.plans.staging import stg_term_calendar


@pytest.fixture(scope="module")
def edge(spark):
    return Tables(spark, SF_DIR, edge=True)


@pytest.fixture(scope="module")
def plain(spark):
    return Tables(spark, SF_DIR)


def test_retention_edges(edge, rows):
    found = edge.retention_term.filter("degtype = 'XX'").select(
        "current_term", "school", "prior_students", "graduates_excluded", "continuing_students",
        "adjusted_retention_rate", "attrition_rate_pct")
    assert rows(found) == sorted([
        # A graduate who comes back lifts the rate above 100.
        ("201990", "EN", 3, 2, 2, 200.0, -100.0),
        # A NULL attribute finds no partner, though the student continues.
        ("201990", None, 1, 0, 0, 0.0, 100.0),
        ("202010", "EN", 3, 0, 0, 0.0, 100.0),
    ], key=repr)


def test_graduation_edges(edge, rows):
    found = edge.grad_term.filter("degtype = 'XX' AND current_term = '201990'").select(
        "gender", "school", "pell", "prior_students", "graduated_students")
    assert rows(found) == sorted([
        ("Female", "EN", "Y", 2, 1), ("Female", None, "Y", 1, 0), (None, "EN", "Y", 1, 0)], key=repr)


def test_one_episode_per_key(plain):
    e = plain.episodes
    assert e.count() == e.select("student_id", "u_g", "degtype").distinct().count() == 162


def test_cohort_sizes_add_up(plain):
    total = plain.grad.agg(F.sum("cohort_size")).first()[0]
    assert total == facts.matured_cohorts(plain.episodes).count()


def test_numerators_within_denominators(plain):
    assert plain.grad.filter("graduated_count > cohort_size").count() == 0
    assert plain.retention.filter("one_year_retained_count > one_year_eligible_cohort_size "
                                  "OR two_year_retained_count > two_year_eligible_cohort_size").count() == 0


def test_retention_and_attrition_make_one_hundred(plain):
    assert plain.retention_term.filter(
        "abs(adjusted_retention_rate + attrition_rate_pct - 100) > 0.0002").count() == 0


def test_enrollment_fact_keeps_every_keyed_row_whatever_is_hot(plain, spark, rows, tmp_path):
    assert plain.fct_enrollment.count() == plain.lnd.count() == 1160
    hot = plain.typed.limit(1).select("*").crossJoin(spark.range(600)).drop("id")
    plain.typed.unionByName(hot).write.parquet(str(tmp_path / "stg"))
    plain.episodes.write.parquet(str(tmp_path / "epi"))
    fact = facts.fct_enrollment_term(spark.read.parquet(str(tmp_path / "stg")), spark.read.parquet(str(tmp_path / "epi")))
    assert fact.count() == 1760
    assert fact._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    ids = {tuple(r[:3]): r[3] for r in plain.episodes.select("student_id", "u_g", "degtype", "program_episode_id").collect()}
    assert all(ids[tuple(r[:3])] == r[3] for r in fact.select("student_id", "u_g", "degtype", "program_episode_id").collect())


def test_eligible_term_rate_by_brute_force(plain):
    episodes = [r.asDict() for r in plain.episodes.filter("is_first_time_cohort = 1").collect()]
    terms = [r[0] for r in plain.calendar.select("current_term").collect()]
    want = {}
    for t in terms:
        for e in episodes:
            due = int(e["cohort_term"]) + facts.MATURITY_WINDOWS[e["u_g"]] <= int(t)
            if due and (e["graduation_term"] is None or e["graduation_term"] >= t):
                key = (t, e["degtype"], e["u_g"], e["cohort_gender"], e["cohort_school"], e["cohort_pell"])
                n, g = want.get(key, (0, 0))
                want[key] = (n + 1, g + (e["graduation_term"] == t))
    found = facts.graduation_term_eligible(plain.episodes, plain.calendar).collect()
    got = {(r["current_term"], r["degtype"], r["u_g"], r["gender"], r["school"], r["pell"]):
           (r["eligible_students"], r["graduated_students"]) for r in found}
    assert got == want and got


def test_stored_entries_give_the_same_facts_and_odd_codes_one_move(enrollment, rows):
    df = enrollment([
        ("A", "201890", "Enrolled", "1"), ("A", "201910", "Graduated", "4", {"pell": "N"}), ("A", "201910", "Enrolled", "4"),
        # Both lead to 201990, the first with a graduation between, the second without.
        ("A", "2019x10", "Enrolled", "4"), ("A", "201990", "Enrolled", "4"),
        ("B", "201910", "Enrolled", "1", {"school": None}), ("B", "201990", "Enrolled", "4", {"degtype": None}),
        (None, "201910", "Graduated", "1"), ("B", None, "Graduated", "4"), ("C", "201990", "Enrolled", "1")])
    calendar, entries = stg_term_calendar(df), program_entries(df)
    for dims in (["school"], ["gender", "school", "pell"]):
        moves = facts.term_moves(df, calendar, dims)
        assert rows(moves) == rows(facts.term_moves(df, calendar, dims, entries))
        assert moves.count() == moves.select("current_term", "student_id", "degtype", *dims).distinct().count()
    mine = moves.filter("student_id = 'A' AND current_term = '201990'").select("pell", "continued", "graduated")
    assert rows(mine) == [("N", 1, 1), ("Y", 1, 1)]
    assert rows(moves.filter("student_id IS NULL OR school IS NULL").select("continued", "graduated")) == [(0, 0), (0, 0)]
    for fact in (facts.fct_graduation_rate_term, facts.fct_retention_rate_term):
        assert rows(fact(df, calendar)) == rows(fact(df, calendar, entries))
