"""The SQL each registered query is compared with.

Major terms are numbered, so a term some hops on is a sum; an episode is read
off the list of its key's rows; term moves are windows over a program's rows.
Rates are rounded with whole numbers, so a half always rounds away from zero.
"""

from __future__ import annotations

from termwise import inputs
from termwise.checks import expected
from termwise.checks.chunk_sql import chunk_ctes
from termwise.checks.queries import METRIC_GROUPINGS


def rate(top: str, bottom: str, scale: int = 4) -> str:
    unit = 10 ** scale
    return (
        f"CASE WHEN ({bottom}) <> 0 THEN CAST(sign({top}) * ((2 * abs(CAST({top} AS HUGEINT)) * {100 * unit} + ({bottom}))"
        f" // (2 * ({bottom}))) AS DOUBLE) / {unit} END"
    )


def _season(c: str) -> str:
    return (f"CASE right({c}, 2) WHEN '10' THEN 'Spring' WHEN '50' THEN 'Summer' WHEN '90' THEN 'Fall' "
            f"WHEN '95' THEN 'Winter' END")


def _next(c: str) -> str:
    return (f"CASE WHEN right({c}, 2) = '90' THEN CAST(CAST(left({c}, 4) AS INT) + 1 AS STRING) || '10' "
            f"WHEN right({c}, 2) = '10' THEN left({c}, 4) || '90' END")


def _previous(c: str) -> str:
    return (f"CASE WHEN right({c}, 2) = '10' THEN CAST(CAST(left({c}, 4) AS INT) - 1 AS STRING) || '90' "
            f"WHEN right({c}, 2) = '90' THEN left({c}, 4) || '10' END")


_LND = inputs.LND_SQL.replace("{orders}", "orders")
_STAGED = inputs.STAGED_SQL.replace("{lnd}", "lnd")
_RISK = inputs.RISK_SQL.replace("{lnd}", "lnd")
_QUESTIONS = inputs.QUESTIONS_SQL.replace("{conversations}", "conversations")


def _values(codes: dict) -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in codes.items())


def _seed(codes: dict, code: str, text: str) -> str:
    return f"(SELECT CAST(a AS STRING) AS {code}, b AS {text} FROM (VALUES {_values(codes)}) AS v(a, b))"


_STG = f"""
SELECT student_id, u_g, gender, school, sc.school_name, degtype,
  CASE WHEN nullif(trim(firstgen), '') IS NULL THEN 'Unknown' ELSE firstgen END AS firstgen,
  CASE WHEN nullif(trim(pell), '') IS NULL THEN 'Unknown' ELSE pell END AS pell,
  ethnicmultirace AS ethnicity_code, eth.ethnicity_description,
  citizen AS citizen_code, cz.citizen_description,
  CAST(creditenr AS INTEGER) AS creditenr, CAST(accumgpa AS DECIMAL(4,2)) AS accumgpa,
  academic_state, regstat AS regstat_code, rs.regstat_description, term_code,
  CAST(left(term_code, 4) AS INT) AS term_year, {_season('term_code')} AS term_season
FROM lnd s
LEFT JOIN {_seed(expected.SCHOOLS, 'school_code', 'school_name')} sc ON s.school = sc.school_code
LEFT JOIN {_seed(expected.CITIZENSHIP, 'citizen_code', 'citizen_description')} cz ON s.citizen = cz.citizen_code
LEFT JOIN {_seed(expected.REGISTRATION, 'regstat_code', 'regstat_description')} rs ON s.regstat = rs.regstat_code
LEFT JOIN {_seed(expected.ETHNICITY, 'ethnicity_code', 'ethnicity_description')} eth
  ON s.ethnicmultirace = eth.ethnicity_code
"""

_CAL = f"""
SELECT DISTINCT term_code AS current_term, {_next('term_code')} AS next_major_term
FROM stg WHERE right(term_code, 2) IN ('10', '90')
"""

# A major term as a number: two a year, so the next one is one more.
def _nth(c: str) -> str:
    return f"CASE right({c}, 2) WHEN '10' THEN 2 * CAST(left({c}, 4) AS INT) WHEN '90' THEN 2 * CAST(left({c}, 4) AS INT) + 1 END"


def _code(n: str) -> str:
    return f"(CAST(({n}) // 2 AS STRING) || CASE ({n}) % 2 WHEN 0 THEN '10' ELSE '90' END)"


_CHECKS = f"""
SELECT current_term AS cohort_term, {_code('n + 2')} AS one_year_check_term, {_code('n + 4')} AS two_year_check_term
FROM (SELECT current_term, {_nth('current_term')} AS n, list({_nth('current_term')}) OVER () AS present FROM cal) numbered
WHERE list_has_all(present, [n + 1, n + 2, n + 3])
"""

# Every row of a key in one list; what an episode is, is read off that list.
_BOUNDS = f"""
SELECT student_id, u_g, degtype, entry AS cohort_term, list_max([r.t FOR r IN rows]) AS last_term,
  CAST(list_contains([r.reg FOR r IN rows], '1') AS INT) AS is_first_time_cohort,
  CAST(list_contains([r.state FOR r IN rows], 'Graduated') AS INT) AS graduated_flag,
  list_min([r.t FOR r IN rows IF r.state = 'Graduated']) AS graduation_term,
  list_max([r.school FOR r IN rows IF r.t = entry]) AS cohort_school,
  list_max([r.pell FOR r IN rows IF r.t = entry]) AS cohort_pell,
  list_max([r.fg FOR r IN rows IF r.t = entry]) AS cohort_firstgen,
  list_max([r.sex FOR r IN rows IF r.t = entry]) AS cohort_gender,
  CAST(left(entry, 4) AS INT) AS cohort_year, {_season('entry')} AS cohort_season,
  [r.t FOR r IN rows] AS attended, concat_ws('-', student_id, u_g, degtype, entry) AS program_episode_id
FROM (
  SELECT student_id, u_g, degtype, min(term_code) AS entry,
    list({{'t': term_code, 'reg': regstat_code, 'state': academic_state, 'school': school, 'pell': pell,
           'fg': firstgen, 'sex': gender}}) AS rows
  FROM stg WHERE student_id IS NOT NULL AND u_g IS NOT NULL AND degtype IS NOT NULL GROUP BY student_id, u_g, degtype) k
WHERE entry IS NOT NULL
"""

_EPI = f"""
SELECT program_episode_id, student_id, u_g, degtype, cohort_term, cohort_year, cohort_season, cohort_school, cohort_pell,
  cohort_firstgen, cohort_gender, last_term, is_first_time_cohort, graduated_flag, graduation_term,
  CAST(coalesce(list_contains(attended, {_code('n + 1')}), false) AS INT) AS enrolled_next_term,
  CAST(coalesce(list_has_all(present, [n + 1]) AND list_contains(attended, {_code('n + 2')}), false) AS INT) AS retained_one_year,
  CAST(coalesce(list_has_all(present, [n + 1, n + 2, n + 3]) AND list_contains(attended, {_code('n + 4')}), false) AS INT)
    AS retained_two_year,
  CAST(coalesce(list_has_all(present, [n + 1, n + 2, n + 3]) AND graduation_term <= {_code('n + 2')}, false) AS INT)
    AS graduated_before_one_year_mark,
  CAST(coalesce(list_has_all(present, [n + 1, n + 2, n + 3]) AND graduation_term <= {_code('n + 4')}, false) AS INT)
    AS graduated_before_two_year_mark
FROM (SELECT *, {_nth('cohort_term')} AS n FROM bounds) b
CROSS JOIN (SELECT list({_nth('current_term')}) AS present FROM cal) c
"""

_DIM = """
SELECT program_episode_id, student_id, u_g, degtype, cohort_term, cohort_year, cohort_season,
  cohort_school AS school, cohort_pell AS pell, cohort_firstgen AS firstgen, cohort_gender AS gender,
  last_term, is_first_time_cohort FROM epi
"""

_ENR = """
SELECT e.student_id, e.u_g, e.degtype, e.term_code, e.term_year, e.term_season, e.school, e.school_name, e.pell,
  e.firstgen, e.ethnicity_description, e.citizen_description, e.creditenr, e.accumgpa, e.academic_state,
  e.regstat_description, pe.program_episode_id, pe.cohort_term, pe.is_first_time_cohort
FROM stg e JOIN epi pe ON pe.student_id = e.student_id AND pe.u_g = e.u_g AND pe.degtype = e.degtype
"""

_MATURED = """
SELECT * FROM epi
QUALIFY is_first_time_cohort = 1 AND CAST(cohort_term AS INT) + map(['U', 'G', 'D'], [400, 200, 500])[u_g]
  <= max(CAST(cohort_term AS INT)) OVER ()
"""

_COHORT = "degtype, u_g, cohort_gender, cohort_school, cohort_pell, cohort_year"
_GRAD = f"""
SELECT degtype, u_g, cohort_gender AS gender, cohort_school AS school, cohort_pell AS pell, cohort_year,
  count(*) AS cohort_size, count(*) FILTER (graduated_flag = 1) AS graduated_count,
  {rate('count(*) FILTER (graduated_flag = 1)', 'count(*)')} AS graduation_rate_pct
FROM matured GROUP BY {_COHORT}
"""


def _kept(years: str, wait: int) -> str:
    """Columns of one retention mark: who is old enough and not done by then, and who of them is there."""
    due = f"age >= {wait} AND graduated_before_{years}_year_mark = 0"
    there = f"count(*) FILTER ({due} AND retained_{years}_year = 1)"
    name = {"one": "first", "two": "second"}[years]
    return (f"count(*) FILTER ({due}) AS {years}_year_eligible_cohort_size, {there} AS {years}_year_retained_count, "
            f"{rate(there, f'count(*) FILTER ({due})')} AS {name}_year_retention_rate_pct")


_RETC = f"""
SELECT degtype, u_g, cohort_gender AS gender, cohort_school AS school, cohort_pell AS pell, cohort_year,
  {_kept('one', 100)}, {_kept('two', 200)}
FROM (SELECT *, max(CAST(cohort_term AS INT)) OVER () - CAST(cohort_term AS INT) AS age FROM epi) aged
WHERE is_first_time_cohort = 1 GROUP BY {_COHORT}
"""

def _moves(dims: str) -> str:
    """A row per (following term, student, program, attributes): there in it, and done before it."""
    d = [x.strip() for x in dims.split(",")]
    known = " AND ".join(f"{c} IS NOT NULL" for c in ["student_id", "u_g", "degtype", *d])
    return f"""
SELECT student_id, u_g, degtype, {dims}, {_next('term_code')} AS current_term,
  bool_or({known} AND list_contains(attended, {_next('term_code')})) AS there,
  bool_or({known} AND len([g FOR g IN done IF g >= term_code AND g < {_next('term_code')}]) > 0) AS gone
FROM (SELECT *, list(term_code) OVER program AS attended,
        list(term_code) FILTER (academic_state = 'Graduated') OVER program AS done
      FROM stg WINDOW program AS (PARTITION BY student_id, u_g, degtype)) s
WHERE {_next('term_code')} IN (SELECT current_term FROM cal)
GROUP BY student_id, u_g, degtype, {dims}, term_code"""


def _graduates(dims: str) -> str:
    return (f"SELECT current_term, degtype, u_g, {dims}, count(DISTINCT student_id) AS graduates_excluded "
            f"FROM ({_moves(dims)}) m WHERE gone GROUP BY current_term, degtype, u_g, {dims}")


_CONTINUING = (f"SELECT current_term, degtype, u_g, school, count(DISTINCT student_id) AS continuing_students "
               f"FROM ({_moves('school')}) m WHERE there GROUP BY current_term, degtype, u_g, school")

_GRADT = f"""
SELECT current_term, degtype, u_g, gender, school, pell, count(DISTINCT student_id) AS prior_students,
  count(DISTINCT student_id) FILTER (gone) AS graduated_students,
  {rate('count(DISTINCT student_id) FILTER (gone)', 'count(DISTINCT student_id)')} AS term_graduation_rate_pct
FROM ({_moves('gender, school, pell')}) m GROUP BY current_term, degtype, u_g, gender, school, pell
"""

_RETT = f"""
SELECT current_term, degtype, u_g, school, n AS prior_students, g AS graduates_excluded, n - g AS eligible_prior_students,
  c AS continuing_students, {rate('c', '(n - g)')} AS adjusted_retention_rate, {rate('(n - g - c)', '(n - g)')} AS attrition_rate_pct
FROM (
  SELECT current_term, degtype, u_g, school, count(DISTINCT student_id) AS n,
    count(DISTINCT student_id) FILTER (gone) AS g, count(DISTINCT student_id) FILTER (there) AS c
  FROM ({_moves('school')}) m GROUP BY current_term, degtype, u_g, school) counted
"""

_VIEWS = {
    "lnd": _LND, "staged": _STAGED, "risk": _RISK, "questions": _QUESTIONS, "stg": _STG, "cal": _CAL,
    "checks": _CHECKS, "bounds": _BOUNDS, "epi": _EPI,
    "dim": _DIM, "enr": _ENR, "matured": _MATURED, "grad": _GRAD, "retc": _RETC,
    "gradt": _GRADT, "rett": _RETT,
}
_NEEDS = {
    "lnd": (), "staged": ("lnd",), "risk": ("lnd",), "questions": (), "stg": ("lnd",), "cal": ("stg",),
    "checks": ("cal",), "bounds": ("stg",), "epi": ("bounds", "cal"), "dim": ("epi",),
    "enr": ("epi",), "matured": ("epi",), "grad": ("matured",), "retc": ("epi",),
    "gradt": ("cal",), "rett": ("cal",),
}


def using(views: str, body: str, edge: bool = False) -> str:
    """``body`` with the named views, and what they need, as leading CTEs."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS[name]:
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for view in views.split():
        add(view)
    texts = dict(_VIEWS)
    if edge:
        texts["lnd"] = f"SELECT * FROM ({_LND}) plain UNION ALL SELECT * FROM ({inputs.EDGE_SQL}) edge"
    ctes = ",\n".join(f"{w} AS MATERIALIZED ({texts[w]})" for w in wanted)
    return f"WITH {ctes}\n{body}"


ORACLES: dict[str, str] = {}
O = ORACLES

# Sources and landing

_NULLED = ", ".join(f"nullif({c}, '') AS {c}" for c in expected.LANDING)
_WIDE = "SELECT * REPLACE (CASE WHEN citizen = '3' THEN '333' ELSE citizen END AS citizen) FROM staged"


def _reason(alias: str = "") -> str:
    checks = [f"CASE WHEN {c} IS NULL THEN '{c} is null' END" for c in expected.FILLED]
    checks += [f"CASE WHEN length({c}) > {n} THEN '{c} too long' END" for c, n in expected.LANDING.items()]
    return f"coalesce({', '.join(checks)})"


O["scan_staged"] = using("staged", f"SELECT {_NULLED} FROM staged")
O["load_landing"] = using("lnd", "SELECT * FROM lnd")
O["landing_constraints"] = using(
    "staged", f"SELECT coalesce({_reason()}, 'accepted') AS outcome, count(*) AS n_rows FROM ({_WIDE}) s GROUP BY 1")
O["load_rejects"] = using(
    "staged", f"SELECT * FROM (SELECT student_id, u_g, degtype, term_code, {_reason()} AS reject_reason "
              f"FROM (SELECT {_NULLED} FROM ({_WIDE}) w) s) r WHERE reject_reason IS NOT NULL "
              f"UNION ALL SELECT student_id, u_g, degtype, term_code, 'more than 16 fields' "
              f"FROM (SELECT {_NULLED} FROM staged WHERE pell = 'X') x")
O["load_report"] = using(
    "staged", f"SELECT count(*) AS rows_parsed, count(*) FILTER (r IS NULL) AS rows_loaded, "
              f"count(r) AS rows_rejected, count(*) FILTER (r IS NULL) AS table_rows "
              f"FROM (SELECT {_reason()} AS r FROM ({_WIDE}) s) j")
_WIDE_LND = "SELECT * REPLACE (CASE WHEN citizen = '3' THEN '333' ELSE citizen END AS citizen) FROM lnd"
O["append_twice"] = using("lnd", f"SELECT {_NULLED} FROM lnd WHERE citizen <> '3'")
O["load_report_by_file"] = using("lnd", f"""
SELECT u_g AS level, count(*) AS rows_parsed, count(*) FILTER (r IS NULL) AS rows_loaded, count(r) AS rows_rejected,
  true AS has_size, 1 AS loads
FROM (SELECT u_g, {_reason()} AS r FROM ({_WIDE_LND}) s) j GROUP BY 1""")
O["seed_lookups"] = using("stg", """
SELECT 'school' AS code_list, school AS code, school_name AS description, count(*) AS n_rows FROM stg GROUP BY 2, 3
UNION ALL SELECT 'citizen_code', citizen_code, citizen_description, count(*) FROM stg GROUP BY 2, 3
UNION ALL SELECT 'regstat_code', regstat_code, regstat_description, count(*) FROM stg GROUP BY 2, 3
UNION ALL SELECT 'ethnicity_code', ethnicity_code, ethnicity_description, count(*) FROM stg GROUP BY 2, 3""")
_START = "make_date(term_year, CASE WHEN term_season = 'Spring' THEN 1 ELSE 9 END, 1)"
_SPINE = "SELECT CAST(unnest(generate_series(DATE '2015-01-01', DATE '2029-12-31', INTERVAL 1 DAY)) AS DATE) AS d"
O["time_spine"] = using("stg", f"""
SELECT CAST(s.d AS STRING) AS date_day, coalesce(n, 0) AS enrollments_starting FROM ({_SPINE}) s
LEFT JOIN (SELECT {_START} AS d, count(*) AS n FROM stg GROUP BY 1) x ON x.d = s.d""")

O["audit_columns"] = using("cal", """
SELECT current_term, true AS has_loaded_at, true AS updated_since, true AS has_updated_by FROM cal""")

# Quality

_BAD = {
    2: "student_id IS NULL OR u_g IS NULL OR degtype IS NULL OR school IS NULL OR term_code IS NULL",
    3: "length(term_code) <> 6 OR right(term_code, 2) NOT IN ('10', '50', '90', '95') "
       "OR NOT regexp_full_match(term_code, '[0-9]{6}')",
    5: "u_g NOT IN ('U', 'G', 'D')",
    6: "school NOT IN ('AD', 'CC', 'EN', 'SL', 'SM')",
    7: "pell NOT IN ('Y', 'N', '') AND pell IS NOT NULL",
    8: "regstat NOT IN ('1', '2', '3', '4')",
    9: "academic_state NOT IN ('Enrolled', 'Graduated', 'Maintaining Registration')",
}


def _qc() -> str:
    def line(n: int, value: str) -> str:
        name = expected.CHECKS[n - 1].replace("'", "''")
        ok = "value > 0" if n == 1 else "value = 0"
        return (f"SELECT CAST({n} AS INTEGER) AS check_no, '{name}' AS name, value, "
                f"CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status FROM ({value}) v{n}")

    parts = [line(1, "SELECT count(*) AS value FROM staged")]
    parts += [line(n, f"SELECT count(*) AS value FROM staged WHERE {bad}") for n, bad in _BAD.items()]
    parts.append(line(4, "SELECT count(*) AS value FROM (SELECT 1 FROM staged "
                         "GROUP BY student_id, u_g, degtype, term_code HAVING count(*) > 1) g"))
    return " UNION ALL ".join(parts)


O["qc_checks"] = using("staged", _qc())
O["blocked_load"] = using("staged", f"SELECT *, 0 AS table_rows FROM ({_qc()}) c")
O["qc_summary"] = using("staged", f"""
SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) AS total,
  CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'BLOCKED' ELSE 'OK' END AS decision FROM ({_qc()}) c""")

_MODEL_VIEW = {
    "stg_student_enrollment": "stg", "stg_term_calendar": "cal", "int_program_episodes": "epi",
    "dim_program_episode": "dim", "fct_enrollment_term": "enr", "fct_graduation_rate": "grad",
    "fct_retention_rate_cohort": "retc", "fct_graduation_rate_term": "gradt", "fct_retention_rate_term": "rett",
    "staged": "staged",
}

_REPORTS = ("dim_program_episode", "fct_enrollment_term", "fct_graduation_rate", "fct_retention_rate_cohort",
            "fct_graduation_rate_term", "fct_retention_rate_term", "stg_student_enrollment")
O["catalog_views"] = using("stg dim enr grad retc gradt rett", " UNION ALL ".join(
    f"SELECT 'vw_{name}' AS view_name, count(*) AS n_rows, 0 AS n_stale, 6 AS n_stored FROM {_MODEL_VIEW[name]}"
    for name in _REPORTS))
O["failed_rebuild"] = using("stg cal", """
SELECT c.*, n AS n_rows, 2 AS n_stored FROM cal c
JOIN (SELECT term_code, count(*) AS n FROM stg GROUP BY 1) s ON term_code = current_term""")


def _data_test(model: str, test: str, cols: tuple, values: tuple) -> str:
    view = _MODEL_VIEW[model]
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    if test == "not_null":
        found = f"SELECT count(*) FROM {view} WHERE {cols[0]} IS NULL"
    elif test == "accepted_values":
        found = f"SELECT count(*) FROM {view} WHERE {cols[0]} NOT IN ({listed})"
    elif test == "accepted_range":
        found = f"SELECT count(*) FROM {view} WHERE NOT ({cols[0]} >= {values[0]} AND {cols[0]} <= {values[1]})"
    elif test == "expression_is_true":
        found = (f"SELECT count(*) FROM {view} WHERE coalesce(NOT ({cols[0]} <= "
                 f"(SELECT max(cohort_year) FROM epi) - {values[0]}), true)")
    else:
        keep = f"WHERE {cols[0]} IS NOT NULL" if test == "unique" else ""
        found = f"SELECT count(*) FROM (SELECT 1 FROM {view} {keep} GROUP BY {', '.join(cols)} HAVING count(*) > 1) g"
    return (f"SELECT '{model}' AS model, '{test}' AS test, '{', '.join(cols)}' AS column_name, "
            f"({found}) AS failures")


def _suite(tests, views: str, edge: bool = False) -> str:
    return using(views, " UNION ALL ".join(_data_test(*t) for t in tests), edge)


def _t(test, *columns, values=(), model="staged"):
    return model, test, columns, values


O["dt_not_null"] = _suite([_t("not_null", c) for c in ("student_id", "u_g", "school", "term_code")], "staged")
O["dt_unique"] = _suite([_t("unique", "student_id"),
                         _t("unique", "program_episode_id", model="int_program_episodes")], "staged epi")
O["dt_accepted_values"] = _suite([
    _t("accepted_values", "u_g", values=("U", "G", "D")),
    _t("accepted_values", "school", values=("AD", "CC", "EN", "SL", "SM")),
    _t("accepted_values", "pell", values=("Y", "N", "Unknown")),
    _t("accepted_values", "academic_state", values=("Enrolled", "Graduated", "Maintaining Registration"))], "staged")
O["dt_unique_combination"] = _suite([_t("unique_combination", "student_id", "u_g", "degtype", "term_code")], "staged")
O["dt_accepted_range"] = _suite(
    [_t("accepted_range", c, values=(0, 100), model="fct_retention_rate_term")
     for c in ("adjusted_retention_rate", "attrition_rate_pct")], "rett", edge=True)
O["dt_expression_true"] = _suite(
    [_t("expression_is_true", "cohort_year", values=(2,), model=m)
     for m in ("fct_graduation_rate", "fct_retention_rate_cohort")], "grad retc")
O["dt_suite"] = _suite(expected.TESTS, "stg cal epi dim enr grad retc gradt rett", edge=True)

# Scalar functions

O["term_decode"] = using("stg", f"""
SELECT student_id, u_g, term_code, term_year, term_season, {_next('term_code')} AS next_major_term,
  {_previous('term_code')} AS previous_major_term FROM stg""")
O["term_shift"] = using("stg", """
SELECT student_id, u_g, term_code, CAST(term_year + 3 AS STRING) || substr(term_code, 5) AS three_later,
  CAST(term_year - 1 AS STRING) || substr(term_code, 5) AS one_earlier,
  CAST(term_code AS INT) - 100 AS one_earlier_number FROM stg""")
O["blank_to_unknown"] = using("lnd", """
SELECT student_id, u_g, term_code,
  CASE WHEN nullif(trim(firstgen), '') IS NULL THEN 'Unknown' ELSE firstgen END AS firstgen,
  CASE WHEN nullif(trim(pell), '') IS NULL THEN 'Unknown' ELSE pell END AS pell,
  CASE WHEN pell = '' THEN 'Unknown' ELSE pell || ' ' END AS padded_pell FROM lnd""")
O["typed_cast"] = using("lnd", """
SELECT student_id, u_g, term_code, CAST(creditenr AS INTEGER) AS credits,
  CAST(floor(CAST(accumgpa AS DOUBLE) + 0.5) AS INTEGER) AS rounded_gpa, CAST(accumgpa AS DOUBLE) AS gpa,
  CAST(TRY_CAST(creditenr || accumgpa AS DECIMAL(4,2)) AS DOUBLE) AS overflowing_gpa,
  TRY_CAST(creditenr || 'x' AS INTEGER) AS not_a_number FROM lnd""")
O["time_dimensions"] = using("stg", f"""
SELECT student_id, u_g, term_code, CAST(make_date(term_year, 9, 1) AS STRING) AS cohort_start_date,
  CAST({_START} AS STRING) AS term_start_date FROM stg""")
_SIX = "degtype || '-' || u_g || '-' || gender || '-' || school || '-' || pell || '-' || CAST(cohort_year AS STRING)"
O["entity_keys"] = using("grad retc rett enr", f"""
SELECT 'graduation_rate' AS model, {_SIX} AS entity_key FROM grad
UNION ALL SELECT 'retention_rate_cohort', {_SIX} FROM retc
UNION ALL SELECT 'retention_rate_term', current_term || '-' || degtype || '-' || u_g || '-' || school FROM rett
UNION ALL SELECT 'enrollment_by_semester_level', program_episode_id || '-' || term_code FROM enr""")

# Staging, episodes and facts

O["stg_student_enrollment"] = using("stg", "SELECT * REPLACE (CAST(accumgpa AS DOUBLE) AS accumgpa) FROM stg")
O["stg_term_calendar"] = using("cal", "SELECT * FROM cal")
O["check_terms"] = using("checks", "SELECT * FROM checks")
O["cohort_term_flag"] = using("stg", """
SELECT student_id, u_g, degtype, term_code,
  CASE WHEN term_code = min(term_code) OVER (PARTITION BY student_id, u_g, degtype) THEN 1 ELSE 0 END
    AS is_cohort_term_row FROM stg""")
O["int_program_episodes"] = using("epi", "SELECT * FROM epi")
O["dim_program_episode"] = using("dim", "SELECT * FROM dim")
O["fct_enrollment_term"] = using("enr", "SELECT * REPLACE (CAST(accumgpa AS DOUBLE) AS accumgpa) FROM enr")
O["matured_cohorts"] = using("matured", "SELECT program_episode_id, u_g, cohort_term, graduated_flag FROM matured")
O["fct_graduation_rate"] = using("grad", "SELECT * FROM grad")
O["fct_retention_rate_cohort"] = using("retc", "SELECT * FROM retc")
O["graduates_between_terms"] = using("cal", f"""
SELECT * FROM ({_graduates('school')}) g WHERE school IS NOT NULL""", edge=True)
O["continuing_students"] = using("cal", f"""
SELECT * FROM ({_CONTINUING}) c WHERE school IS NOT NULL""", edge=True)
O["fct_graduation_rate_term"] = using("gradt", "SELECT * FROM gradt", edge=True)
O["fct_retention_rate_term"] = using("rett", "SELECT * FROM rett", edge=True)
O["graduation_term_eligible"] = using("cal epi", f"""
SELECT current_term, degtype, u_g, gender, school, pell, eligible_students, graduated_students,
  {rate('graduated_students', 'eligible_students')} AS term_graduation_rate_pct
FROM (
  SELECT c.current_term, e.degtype, e.u_g, e.cohort_gender AS gender, e.cohort_school AS school, e.cohort_pell AS pell,
    count(*) AS eligible_students, count(*) FILTER (e.graduation_term = c.current_term) AS graduated_students
  FROM cal c JOIN epi e ON e.is_first_time_cohort = 1
    AND CAST(e.cohort_term AS INT) + CASE e.u_g WHEN 'U' THEN 400 WHEN 'G' THEN 200 WHEN 'D' THEN 500 END
        <= CAST(c.current_term AS INT)
    AND (e.graduation_term IS NULL OR e.graduation_term >= c.current_term)
  GROUP BY 1, 2, 3, 4, 5, 6) x""")

# Aggregates, semi joins and top rows

O["headcount_by_term"] = using("enr", "SELECT term_code, count(DISTINCT student_id) AS student_count FROM enr GROUP BY 1")
O["semi_in"] = using("enr dim", """
SELECT term_code, count(DISTINCT student_id) AS student_count FROM enr
WHERE student_id IN (SELECT student_id FROM dim WHERE is_first_time_cohort = 1) GROUP BY 1""")
O["semi_exists"] = using("enr", """
SELECT term_code, count(DISTINCT student_id) AS student_count FROM enr e
WHERE EXISTS (SELECT 1 FROM enr g WHERE g.student_id = e.student_id AND g.academic_state = 'Graduated') GROUP BY 1""")
O["join_dim_filter"] = using("enr dim", """
SELECT e.term_code, d.u_g AS entry_level, count(DISTINCT e.student_id) AS student_count
FROM enr e JOIN dim d ON d.student_id = e.student_id WHERE d.is_first_time_cohort = 1 GROUP BY 1, 2""")


O["pell_enrollment_rate"] = using("enr", f"""
SELECT school, u_g, n AS student_count, y AS pell_students, o AS other_students, {rate('y', 'n', 2)} AS pell_enrollment_rate
FROM (SELECT school, u_g, count(DISTINCT student_id) AS n,
        count(DISTINCT CASE WHEN pell = 'Y' THEN student_id END) AS y,
        count(DISTINCT CASE WHEN pell = 'N' THEN student_id END) AS o FROM enr GROUP BY 1, 2) x""")


def _sum(column: str) -> str:
    return f"CAST(sum({column}) AS BIGINT)"


O["subset_rate"] = using("grad", f"""
SELECT school, pell, {_sum('cohort_size')} AS cohort_size, {_sum('graduated_count')} AS graduated_count,
  {rate('sum(graduated_count)', 'sum(cohort_size)')} AS graduation_rate_pct FROM grad GROUP BY 1, 2""")
O["weighted_rate"] = using("rett", """
SELECT current_term, CASE WHEN w > 0 THEN CAST((2 * n + 100 * w) // (200 * w) AS DOUBLE) / 100 END
  AS adjusted_retention_rate_pct
FROM (SELECT current_term, sum(CAST(round(adjusted_retention_rate * 10000) AS HUGEINT) * eligible_prior_students) AS n,
        sum(eligible_prior_students) AS w FROM rett GROUP BY 1) x""")
_HEADS = """count(DISTINCT student_id) AS student_count, count(DISTINCT CASE WHEN pell = 'Y' THEN student_id END) AS pell_student_count,
  count(DISTINCT CASE WHEN firstgen = 'Y' THEN student_id END) AS firstgen_enrollment_count,
  count(DISTINCT CASE WHEN creditenr >= 12 THEN student_id END) AS full_time_students,
  count(DISTINCT CASE WHEN creditenr < 12 THEN student_id END) AS part_time_students"""
_HEAD_DIMS = ("term_code", "u_g", "school", "pell", "gender", "firstgen")
O["headcounts_from_bitmaps"] = using("stg", " UNION ALL ".join(
    "SELECT " + ", ".join(d if d in by.split() else f"CAST(NULL AS STRING) AS {d}" for d in _HEAD_DIMS)
    + f", '{by}' AS grouping, {_HEADS} FROM stg WHERE u_g IS NOT NULL AND degtype IS NOT NULL" + (f" GROUP BY {', '.join(by.split())}" if by else "")
    for by in ("term_code u_g", "school pell", "gender firstgen term_code", "")))
O["headcount_cube"] = using("enr", f"""
SELECT term_code, u_g, pell, CAST(grouping_id(term_code, u_g, pell) AS BIGINT) AS grouping_id, {_HEADS}
FROM enr GROUP BY CUBE (term_code, u_g, pell)""")
O["student_numbers"] = using("enr", """
SELECT count(DISTINCT student_id) AS students, count(DISTINCT student_id) AS distinct_students,
  count(DISTINCT student_id) AS numbers, 0 AS least, count(DISTINCT student_id) - 1 AS greatest FROM enr""", edge=True)
O["rate_cube"] = using("grad", f"""
SELECT cohort_year, school, pell, CAST(grouping_id(cohort_year, school, pell) AS BIGINT) AS grouping_id,
  CAST(sum(graduated_count) AS BIGINT) AS graduated_count, CAST(sum(cohort_size) AS BIGINT) AS cohort_size,
  {rate('sum(graduated_count)', 'sum(cohort_size)')} AS graduation_rate_pct
FROM grad GROUP BY CUBE (cohort_year, school, pell)""")
O["current_term"] = using("enr", "SELECT max(term_code) AS current_term FROM enr")


def _best(view: str, where: str, top: str, bottom: str, top_as: str, bottom_as: str, name: str) -> str:
    return using(view, f"""
SELECT cohort_year, {_sum(bottom)} AS {bottom_as}, {_sum(top)} AS {top_as},
  {rate(f'sum({top})', f'sum({bottom})', 2)} AS {name}
FROM {view} WHERE {where} GROUP BY 1 HAVING sum({bottom}) > 0 ORDER BY 4 DESC, 1 LIMIT 1""")


_ONE = ("one_year_retained_count", "one_year_eligible_cohort_size", "retained", "eligible",
        "first_year_retention_rate_pct")
_DONE = ("graduated_count", "cohort_size", "graduated_count", "cohort_size", "graduation_rate_pct")
O["best_cohort_retention"] = _best("retc", "true", *_ONE)
O["best_cohort_graduation"] = _best("grad", "true", *_DONE)
O["answer_rows"] = using("rett", """
SELECT * FROM rett ORDER BY prior_students DESC, current_term, degtype, u_g, school LIMIT 20""")
O["limit_default"] = using("rett", """
SELECT * FROM rett ORDER BY prior_students DESC, current_term, degtype, u_g, school LIMIT 50""")

# Semantic models and metrics

O["sm_graduation_rate"] = using("grad", f"""
SELECT cohort_year, school, {_sum('cohort_size')} AS cohort_size, {_sum('graduated_count')} AS graduated_count
FROM grad GROUP BY 1, 2""")
O["sm_retention_cohort"] = using("retc", "SELECT cohort_year, u_g, " + ", ".join(
    f"{_sum(m)} AS {m}" for m in ("one_year_eligible_cohort_size", "one_year_retained_count",
                                  "two_year_eligible_cohort_size", "two_year_retained_count"))
    + " FROM retc GROUP BY 1, 2")
O["sm_retention_term"] = using("rett", "SELECT current_term, u_g, " + ", ".join(
    f"{_sum(m)} AS {m}" for m in ("prior_students", "graduates_excluded", "eligible_prior_students",
                                  "continuing_students")) + " FROM rett GROUP BY 1, 2")
O["sm_enrollment"] = using("enr", """
SELECT term_code, u_g, school, pell, count(DISTINCT student_id) AS student_count FROM enr GROUP BY 1, 2, 3, 4""")
O["sm_year_grain"] = using("enr", f"""
SELECT CAST(CAST(date_trunc('year', {_START}) AS DATE) AS STRING) AS period, count(DISTINCT student_id) AS student_count
FROM enr GROUP BY 1""")
O["sm_time_grain"] = using("enr", f"""
SELECT CAST(p.period AS STRING) AS period, coalesce(n, 0) AS student_count
FROM (SELECT CAST(date_trunc('month', d) AS DATE) AS period FROM ({_SPINE}) s
      UNION SELECT CAST(date_trunc('month', {_START}) AS DATE) FROM enr WHERE term_year IS NOT NULL) p
LEFT JOIN (SELECT {_START} AS period, count(DISTINCT student_id) AS n FROM enr GROUP BY 1) x ON x.period = p.period""")

_HEADS = "count(DISTINCT student_id)"


def _heads(condition: str) -> str:
    return f"count(DISTINCT CASE WHEN {condition} THEN student_id END)"


def _average(column: str, scale: int, digits: int) -> str:
    """Exact mean of a column with ``digits`` decimals, rounded half up at ``scale``."""
    total = f"sum(CAST(round({column} * {10 ** digits}) AS HUGEINT))"
    up, down = 10 ** scale, 10 ** digits
    return (f"CAST((2 * {total} * {up} + count({column}) * {down}) // (2 * count({column}) * {down}) AS DOUBLE) / {up}")


def _pell(value: str) -> str:
    return rate(f"sum(CASE WHEN pell = '{value}' THEN graduated_count END)",
                f"sum(CASE WHEN pell = '{value}' THEN cohort_size END)")


_METRIC_SQL = {
    "cohort_size": ("grad", _sum("cohort_size")),
    "graduated_count": ("grad", _sum("graduated_count")),
    "graduation_rate": ("grad", rate("sum(graduated_count)", "sum(cohort_size)")),
    "one_year_eligible_cohort_size": ("retc", _sum("one_year_eligible_cohort_size")),
    "one_year_retained_count": ("retc", _sum("one_year_retained_count")),
    "first_year_retention_rate": ("retc", rate("sum(one_year_retained_count)", "sum(one_year_eligible_cohort_size)")),
    "two_year_eligible_cohort_size": ("retc", _sum("two_year_eligible_cohort_size")),
    "two_year_retained_count": ("retc", _sum("two_year_retained_count")),
    "second_year_retention_rate": ("retc", rate("sum(two_year_retained_count)", "sum(two_year_eligible_cohort_size)")),
    "non_graduation_rate": ("grad", rate("(sum(cohort_size) - sum(graduated_count))", "sum(cohort_size)")),
    "students_not_graduated": ("grad", "CAST(sum(cohort_size) - sum(graduated_count) AS BIGINT)"),
    "pell_graduation_gap": ("grad", f"round(({_pell('N')}) - ({_pell('Y')}), 4)"),
    "student_count": ("enr", _HEADS),
    "pell_student_count": ("enr", _heads("pell = 'Y'")),
    "pell_enrollment_rate": ("enr", rate(_heads("pell = 'Y'"), _HEADS, 2)),
    "adjusted_retention_rate": ("rett", rate("sum(continuing_students)", "sum(eligible_prior_students)")),
    "attrition_rate": ("rett", rate("(sum(eligible_prior_students) - sum(continuing_students))",
                                    "sum(eligible_prior_students)")),
    "prior_students": ("rett", _sum("prior_students")),
    "continuing_students": ("rett", _sum("continuing_students")),
    "graduates_excluded": ("rett", _sum("graduates_excluded")),
    "eligible_prior_students": ("rett", _sum("eligible_prior_students")),
    "term_graduation_rate": ("gradt", rate("sum(graduated_students)", "sum(prior_students)")),
    "term_graduated_students": ("gradt", _sum("graduated_students")),
    "avg_gpa": ("enr", _average("accumgpa", 2, 2)),
    "avg_credits": ("enr", _average("creditenr", 1, 0)),
    "full_time_students": ("enr", _heads("creditenr >= 12")),
    "part_time_students": ("enr", _heads("creditenr < 12")),
    "full_time_rate": ("enr", rate(_heads("creditenr >= 12"), _HEADS, 2)),
    "firstgen_enrollment_count": ("enr", _heads("firstgen = 'Y'")),
    "total_unique_students_ever": ("enr", _HEADS),
    "new_program_starts": ("dim", "count(*) FILTER (is_first_time_cohort = 1)"),
    "first_time_student_count": ("dim", "count(*) FILTER (is_first_time_cohort = 1)"),
    "total_program_episodes": ("dim", "count(*)"),
}
for _name, (_view, _value) in _METRIC_SQL.items():
    _by = ", ".join(METRIC_GROUPINGS[_name])
    _where = " HAVING count(*) FILTER (is_first_time_cohort = 1) > 0" if "first_time" in _value else ""
    O[f"m_{_name}"] = using(
        _view, f"SELECT {_by + ', ' if _by else ''}{_value} AS {_name} FROM {_view}"
               + (f" GROUP BY {_by}{_where}" if _by else ""))

O["m_student_count_by_gender"] = using("enr dim", """
SELECT e.term_code, d.gender, count(DISTINCT e.student_id) AS student_count
FROM enr e JOIN dim d ON d.program_episode_id = e.program_episode_id GROUP BY 1, 2""")

# Sample questions


def _cohort_rate(view: str, where: str, by: str, top: str, bottom: str, top_as: str, bottom_as: str, name: str) -> str:
    return using(view, f"""
SELECT {by}, {_sum(bottom)} AS {bottom_as}, {_sum(top)} AS {top_as}, {rate(f'sum({top})', f'sum({bottom})', 2)} AS {name}
FROM {view} WHERE {where} GROUP BY 1""")


O["ask_pell_grad_trend"] = _cohort_rate("grad", "pell = 'Y'", "cohort_year", *_DONE)
O["ask_eng_retention"] = _cohort_rate(
    "retc", "u_g = 'U' AND school = 'EN'", "cohort_year", "one_year_retained_count", "one_year_eligible_cohort_size",
    "retained", "eligible_cohort", "first_year_retention_rate_pct")
O["ask_pell_masters"] = using("enr", """
SELECT term_code, term_year, term_season, count(DISTINCT student_id) AS pell_eligible_masters_students
FROM enr WHERE u_g = 'G' AND pell = 'Y' GROUP BY 1, 2, 3""")
O["ask_grad_by_school"] = _cohort_rate("grad", "cohort_year = 2018", "school", *_DONE)
O["ask_female_masters_2yr"] = _cohort_rate(
    "retc", "u_g = 'G' AND gender = 'Female'", "cohort_year", "two_year_retained_count",
    "two_year_eligible_cohort_size", "retained", "eligible", "second_year_retention_rate_pct")
O["ask_enrollment_trend"] = using("enr", """
SELECT term_code, term_season, term_year, count(DISTINCT student_id) AS total_enrolled
FROM enr WHERE school = 'EN' GROUP BY 1, 2, 3""")
O["ask_attrition_term"] = using("rett", f"""
SELECT current_term, {_sum('prior_students')} AS prior_students, {_sum('graduates_excluded')} AS graduates_excluded,
  {_sum('eligible_prior_students')} AS eligible_prior, {_sum('continuing_students')} AS continuing,
  {rate('(sum(eligible_prior_students) - sum(continuing_students))', 'sum(eligible_prior_students)', 2)} AS attrition_rate_pct
FROM rett WHERE current_term = '201910' AND u_g = 'U' GROUP BY 1""")
O["ask_phd_starts"] = using("dim", """
SELECT count(*) AS new_phd_students FROM dim
WHERE u_g = 'D' AND school = 'CC' AND cohort_year = 2019 AND is_first_time_cohort = 1""")
O["ask_avg_gpa"] = using("enr", f"""
SELECT {_average('accumgpa', 2, 2)} AS avg_gpa FROM enr WHERE school = 'EN' AND pell = 'Y' AND term_code = '201990'""")
O["ask_best_grad"] = _best("grad", "pell = 'Y' AND u_g = 'U'", *_DONE)
O["ask_term_graduates"] = using("gradt", f"""
SELECT {_sum('graduated_students')} AS total_graduates FROM gradt WHERE current_term = '201910'""")
O["ask_pell_gap"] = _cohort_rate("grad", "pell IN ('Y', 'N')", "pell", *_DONE)
O["ask_best_doctoral"] = _best("retc", "u_g = 'D'", *_ONE)
O["risk_by_school"] = using("risk", """
SELECT school, n AS scored_students, CAST((2 * s * 1000 + n) // (2 * n) AS DOUBLE) / 1000000 AS avg_dropout_probability
FROM (SELECT school, count(*) AS n, sum(CAST(round(dropout_probability * 1000) AS HUGEINT)) AS s
      FROM risk WHERE risk_flag IS NOT NULL GROUP BY 1) x""")
O["risk_counts"] = using("risk", f"""
SELECT count(*) AS students, count(risk_flag) AS scored_students,
  count(*) FILTER (risk_flag = 'YES') AS at_risk_students,
  {rate("count(*) FILTER (risk_flag = 'YES')", 'count(risk_flag)', 2)} AS at_risk_pct,
  {rate('count(risk_flag)', 'count(*)', 2)} AS scored_pct FROM risk""")
O["risk_join_enrollment"] = using("risk enr", """
SELECT e.term_code, r.risk_flag, count(DISTINCT e.student_id) AS students
FROM enr e JOIN risk r ON r.student_id = e.student_id AND CAST(r.term_code AS STRING) = e.term_code GROUP BY 1, 2""")

# Governance

_WORDS = "list_concat(regexp_split_to_array(upper(v), '[^A-Z0-9_]+'), [upper(v)])"
O["leak_scan"] = using("enr", " UNION ALL ".join(f"""
SELECT '{name}' AS column_name, count(*) FILTER (list_has_any({_WORDS}, (SELECT list(DISTINCT student_id) FROM enr)))
  AS leaked_rows FROM (SELECT {value} AS v FROM enr) x""" for name, value in {
    "reference": "lower(student_id)", "school": "school", "term_code": "term_code",
    "note": "'term ' || term_code || ' of ' || student_id", "episode": "program_episode_id",
    "seen": "'[' || school || ', ' || student_id || ']'"}.items()))
O["release_strip"] = using("enr", "SELECT u_g, school, term_code, cohort_term FROM enr")

# Questions, conversations and documents


def _any(words) -> str:
    return "(" + " OR ".join("contains(lower(question), '" + w.replace("'", "''") + "')" for w in words) + ")"


def _route(has_documents: bool) -> str:
    data, document = _any(expected.DATA), _any(expected.DOCUMENT)
    return (f"CASE WHEN {data} AND {document} THEN 'both' WHEN {document} THEN 'rag' WHEN {data} THEN 'sql' "
            f"WHEN len(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')) <= 3 THEN 'clarify' "
            f"ELSE '{'rag' if has_documents else 'sql'}' END")


O["route_questions"] = using("questions", f"""
SELECT *, {_route(False)} AS route_without_documents, {_route(True)} AS route_with_documents FROM questions""")


def _match(pattern: str) -> str:
    return f"regexp_matches(question, '{pattern}', 'i')"


def _resolved(latest: str) -> str:
    return f"""
SELECT conv_id, turn, question, concat_ws(' ', question,
  CASE WHEN {_match(expected.LAST_YEAR)} THEN '(most recent cohort_year: ' || (y - 1) || ')' END,
  CASE WHEN {_match(expected.THIS_YEAR)} THEN '(current cohort_year: ' || y || ')' END,
  CASE WHEN {_match(expected.LAST_TERM)} THEN '(previous major term: ' || prev || ', ' || {_season('prev')} || ' ' || left(prev, 4) || ')' END,
  CASE WHEN {_match(expected.THIS_TERM)} THEN '(current term: ' || t || ', ' || {_season('t')} || ' ' || y || ')' END,
  CASE WHEN {_match(expected.PAST_YEARS)} THEN '(cohort_years '
    || (y - CAST(regexp_extract(question, '{expected.PAST_YEARS}', 1, 'i') AS INT)) || '-' || y || ')' END,
  CASE WHEN {_match(expected.RECENT)} THEN '(data available through: ' || t || ', ' || {_season('t')} || ' ' || y || ')' END
) AS resolved
FROM questions CROSS JOIN (
  SELECT t, CAST(left(t, 4) AS INT) AS y, coalesce({_previous('t')}, t) AS prev FROM ({latest}) m) n"""


O["resolve_terms"] = using("questions enr", _resolved("SELECT max(term_code) AS t FROM enr"))
O["resolve_terms_summer"] = using("questions", _resolved("SELECT '209950' AS t"))
O["chart_intent"] = using("questions", f"""
SELECT *, NOT {_match(expected.NOT_A_CHART)} AND ({_match(expected.CHART_VERB)} OR {_match(expected.CHART_TREND)})
  AS wants_chart FROM questions""")


def _last(n: int) -> str:
    return ("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id "
            f"ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations) w WHERE rn <= {n}")


_TRANSCRIPT = (f"SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript, "
               f"count(*) AS n_messages FROM ({_last(6)}) l GROUP BY 1")
O["conversation_window"] = (f"SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role, text "
                            f"FROM ({_last(20)}) l")
O["recent_transcript"] = _TRANSCRIPT
O["question_in_context"] = using("questions", f"""
SELECT q.conv_id, q.turn, q.question, CASE WHEN t.transcript IS NULL THEN q.question ELSE
  'Said before:' || chr(10) || t.transcript || chr(10) || chr(10) || 'Now asked: ' || q.question END
  AS question_in_context
FROM questions q LEFT JOIN ({_TRANSCRIPT}) t ON t.conv_id = q.conv_id""")
O["upsert_chunks"] = """
SELECT CAST(d.doc_id AS STRING) AS source, 0 AS chunk,
  CASE WHEN l.doc_id IS NULL THEN d.text ELSE 'quality ' || CAST(l.quality AS STRING) || ': ' || d.text END AS text
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def _chunked(docs: str, body: str) -> str:
    return f"WITH RECURSIVE docs AS ({docs}),\n{chunk_ctes('docs')}\n{body}"


_RELOADED = """
SELECT CAST(d.doc_id AS STRING) || '.txt' AS source,
  CASE WHEN l.toxic = 0 THEN 'quality ' || l.quality || chr(10) || d.text ELSE d.text END AS text
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
O["chunk_documents"] = _chunked("SELECT CAST(doc_id AS STRING) AS source, text FROM documents", "SELECT * FROM chunks")
O["chunk_store_reload"] = _chunked(_RELOADED, "SELECT * FROM chunks")
O["chunk_store_sources"] = _chunked(
    _RELOADED, "SELECT source, count(*) AS source_chunks, (SELECT count(*) FROM chunks) AS n_chunks FROM chunks GROUP BY source")
O["load_text_files"] = _chunked(
    "SELECT CAST(doc_id AS STRING) AS source, text || chr(10) AS text FROM documents", "SELECT * FROM chunks")
# The components of a chunk, places without a word as 0.
O["embed_chunks"] = _chunked("SELECT CAST(doc_id AS STRING) AS source, text FROM documents", """,
words AS (
  SELECT source, chunk, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS m FROM chunks),
places AS (
  SELECT source, chunk, CAST('0x' || m[1:4] AS INTEGER) % 64 AS at_place,
    CAST(sum(CASE WHEN CAST('0x' || m[5:5] AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END) AS INTEGER) AS x
  FROM words GROUP BY ALL),
found AS (SELECT source, chunk, map_from_entries(list({'k': at_place, 'v': x})) AS xs FROM places GROUP BY source, chunk)
SELECT c.source, c.chunk, array_to_string(list_transform(range(0, 64), lambda i: coalesce(xs[CAST(i AS INTEGER)], 0)), ',')
  AS features
FROM chunks c LEFT JOIN found f ON f.source = c.source AND f.chunk = c.chunk""")
O["list_sources"] = "SELECT source, count(*) AS n_chunks FROM documents GROUP BY 1"
_NEAREST = """
SELECT query_id, item_id, round(similarity, 6) AS similarity, rank FROM (
  SELECT query_id, item_id, similarity,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS INTEGER) AS rank
  FROM (
    SELECT q.query_id, e.vec_id AS item_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.mean) AS similarity
    FROM embeddings e CROSS JOIN (
      SELECT label AS query_id, list(m ORDER BY i) AS mean FROM (
        SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
        FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) r
        GROUP BY label, i) p GROUP BY label) q) s) ranked
WHERE rank <= 6"""
O["retrieve_topk"] = _NEAREST
_ASKED = "(SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL)"
O["index_lists"] = f"""
SELECT count(*) AS indexed, count(DISTINCT vec_id) AS distinct_items, 6 * {_ASKED} AS answers
FROM embeddings WHERE embedding IS NOT NULL"""
O["index_recall"] = f"SELECT 6 * {_ASKED} AS wanted, true AS recall_ok"
_RULE = expected.RULE.replace("\n", "' || chr(10) || '")
O["assemble_context"] = (
    f"SELECT n.query_id, string_agg('vector ' || e.vec_id || ' of label ' || e.label, '{_RULE}' ORDER BY n.rank) AS context, "
    f"count(*) AS n_excerpts FROM ({_NEAREST}) n JOIN embeddings e ON e.vec_id = n.item_id GROUP BY 1")

_TIME = {"term_code", "semester"}
_METRIC_LIKE = {"creditenr", "accumgpa"}


def _profile(position: int, column: str) -> str:
    number = f"regexp_full_match({column}, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*')"
    return f"""SELECT CAST({position} AS INTEGER) AS position, '{column}' AS column_name, count(*) AS n_rows,
  count({column}) AS non_null, count(*) FILTER ({number}) AS numeric_values, count(DISTINCT {column}) AS distinct_values,
  count(*) FILTER ({number}) = count({column}) AS is_numeric,
  {str(column in _TIME).lower()} AS is_time_axis, {str(column in _METRIC_LIKE).lower()} AS is_metric_name FROM lnd"""


O["profile_columns"] = using("lnd", " UNION ALL ".join(
    _profile(i, c) for i, c in enumerate(expected.LANDING)))
# A column of many values is not counted: far more than 200 of them at any size.
O["profile_bounded"] = using("lnd", "SELECT * REPLACE (CASE WHEN distinct_values < 180 "
                                    "THEN distinct_values END AS distinct_values) FROM (" + " UNION ALL ".join(
    _profile(i, c) for i, c in enumerate(expected.LANDING)) + ") p")
O["series_table"] = using("enr", """
SELECT term_code AS x, pell AS series, CAST(count(DISTINCT student_id) AS DOUBLE) AS y, 'line' AS kind
FROM enr GROUP BY 1, 2""")
