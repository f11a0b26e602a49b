"""Episode rules on hand-made tables."""

from termwise.plans import episodes as ep
from termwise.plans import facts
from termwise.plans.staging import stg_term_calendar

FALL15, SPRING16, FALL16, SPRING17, FALL17, SPRING18 = "201590", "201610", "201690", "201710", "201790", "201810"


def _episodes(df):
    out = ep.int_program_episodes(df, stg_term_calendar(df)).collect()
    return {r["student_id"]: r for r in out}


def _flags(r):
    return (r["enrolled_next_term"], r["retained_one_year"], r["retained_two_year"],
            r["graduated_before_one_year_mark"], r["graduated_before_two_year_mark"])


def _calendar_rows(*terms):
    return [("CAL", t, "Enrolled", "4", {"degtype": "X"}) for t in terms]


def test_whole_chain(enrollment):
    full = [FALL15, SPRING16, FALL16, SPRING17, FALL17]
    e = _episodes(enrollment(_calendar_rows(*full) + [
        ("A", FALL15, "Enrolled", "1"), ("A", SPRING16, "Enrolled", "4"), ("A", FALL16, "Enrolled", "4"),
        ("A", FALL17, "Graduated", "4"),
        ("B", FALL15, "Enrolled", "1"), ("B", FALL16, "Graduated", "4"),
        ("C", FALL15, "Enrolled", "2"),
    ]))
    assert _flags(e["A"]) == (1, 1, 1, 0, 1)
    # Marks are inclusive: graduating in the one-year term counts as before the mark.
    assert _flags(e["B"]) == (0, 1, 0, 1, 1)
    assert _flags(e["C"]) == (0, 0, 0, 0, 0)
    assert e["A"]["program_episode_id"] == "A-U-BS-201590"
    assert (e["A"]["cohort_year"], e["A"]["cohort_season"], e["A"]["last_term"]) == (2015, "Fall", FALL17)
    assert (e["A"]["is_first_time_cohort"], e["C"]["is_first_time_cohort"]) == (1, 0)
    assert (e["A"]["graduated_flag"], e["A"]["graduation_term"]) == (1, FALL17)


def test_calendar_ends_after_one_year(enrollment):
    e = _episodes(enrollment(_calendar_rows(FALL15, SPRING16) + [
        ("A", FALL15, "Enrolled", "1"), ("A", FALL16, "Graduated", "4")]))
    # The two-year chain breaks, so even the one-year early-completion mark is 0.
    assert _flags(e["A"]) == (0, 1, 0, 0, 0)


def test_missing_middle_term_breaks_the_chain(enrollment):
    e = _episodes(enrollment(_calendar_rows(FALL15, FALL16, SPRING17, FALL17) + [
        ("A", FALL15, "Enrolled", "1"), ("A", FALL16, "Enrolled", "4"), ("A", FALL17, "Enrolled", "4")]))
    assert _flags(e["A"]) == (0, 0, 0, 0, 0)


def test_summer_entry_has_no_hops_but_stays_in_denominators(enrollment):
    df = enrollment(_calendar_rows(FALL15, SPRING16, FALL16, SPRING17, FALL17, SPRING18) + [
        ("A", "201550", "Enrolled", "1"), ("A", FALL15, "Enrolled", "4"), ("A", FALL16, "Graduated", "4"),
        ("Z", "201790", "Enrolled", "2")])
    episodes = ep.int_program_episodes(df, stg_term_calendar(df))
    a = episodes.filter("student_id = 'A'").first()
    assert _flags(a) == (0, 0, 0, 0, 0) and a["cohort_term"] == "201550"
    fact = facts.fct_retention_rate_cohort(episodes).collect()
    assert [(r["one_year_eligible_cohort_size"], r["one_year_retained_count"]) for r in fact] == [(1, 0)]


def test_first_time_on_any_row_and_gap_does_not_split(enrollment):
    e = _episodes(enrollment([
        ("A", FALL15, "Enrolled", "2"), ("A", FALL17, "Enrolled", "1")]))
    assert len(e) == 1 and e["A"]["is_first_time_cohort"] == 1


def test_null_key_has_no_episode(enrollment):
    assert _episodes(enrollment([("A", FALL15, "Enrolled", "1", {"degtype": None})])) == {}


def test_duplicate_entry_rows_take_the_greatest_value(enrollment):
    e = _episodes(enrollment([
        ("A", FALL15, "Enrolled", "1", {"school": "AD", "pell": "Y"}),
        ("A", FALL15, "Enrolled", "1", {"school": "SM", "pell": "N", "gender": None}),
        ("A", FALL16, "Enrolled", "4", {"school": "ZZ"}),
    ]))
    a = e["A"]
    assert (a["cohort_school"], a["cohort_pell"], a["cohort_gender"]) == ("SM", "Y", "Female")


def test_attributes_come_from_the_entry_term(enrollment, rows):
    df = enrollment([("A", FALL15, "Enrolled", "1", {"school": "AD"}),
                     ("A", SPRING16, "Enrolled", "4", {"school": "SM"})])
    assert _episodes(df)["A"]["cohort_school"] == "AD"
    flags = ep.with_cohort_flag(df).select("term_code", "is_cohort_term_row")
    assert rows(flags) == [(FALL15, 1), (SPRING16, 0)]


def test_cohort_flag_groups_null_keys_and_survives_hot_keys(enrollment, rows):
    df = enrollment([("A", FALL15, "Enrolled", "1", {"degtype": None}), ("A", FALL16, "Enrolled", "1", {"degtype": None}),
                     ("B", FALL16, "Enrolled", "1")])
    flagged = ep.with_cohort_flag(df).select("student_id", "term_code", "is_cohort_term_row")
    assert rows(flagged) == [("A", FALL15, 1), ("A", FALL16, 0), ("B", FALL16, 1)]
    many = enrollment([("H", FALL15, "Enrolled", "1")] * 50 + [("H", FALL16, "Enrolled", "4")] * 50
                      + [(f"S{i}", FALL16, "Enrolled", "1") for i in range(100)])
    counts = ep.with_cohort_flag(many).groupBy("student_id", "is_cohort_term_row").count().filter("student_id = 'H'")
    assert rows(counts) == [("H", 0, 50), ("H", 1, 50)]


def test_maturity_uses_latest_entry_not_latest_term(enrollment):
    df = enrollment([("A", FALL15, "Enrolled", "1"), ("A", "202090", "Enrolled", "4"),
                     ("B", FALL16, "Enrolled", "1")])
    episodes = ep.int_program_episodes(df, stg_term_calendar(df))
    assert facts.fct_graduation_rate(episodes).count() == 0
    rows = {r["cohort_year"]: r for r in facts.fct_retention_rate_cohort(episodes).collect()}
    assert rows[2015]["one_year_eligible_cohort_size"] == 1
    # Too young to judge: the row stays, the rate is NULL.
    assert rows[2016]["one_year_eligible_cohort_size"] == 0
    assert rows[2016]["first_year_retention_rate_pct"] is None


def test_unknown_level_is_never_matured(enrollment):
    df = enrollment([("A", "201090", "Enrolled", "1", {"u_g": "X"}), ("B", "202090", "Enrolled", "1")])
    episodes = ep.int_program_episodes(df, stg_term_calendar(df))
    assert facts.matured_cohorts(episodes).count() == 0
