import pytest
from conftest import SF_DIR
from termwise.checks.queries import Tables
from termwise.operators.governance import (
    REFUSAL, ReleaseRefused, identifier_columns, leak_scan, mark_identifiers, release, release_strip,
)


@pytest.fixture(scope="module")
def fact(spark):
    df = mark_identifiers(Tables(spark, SF_DIR).fct_enrollment)
    df.createOrReplaceTempView("guarded")
    return df


REFUSED = {
    "bare": "SELECT term_code, student_id FROM guarded",
    "renamed": "SELECT x.student_id AS k FROM guarded AS x",
    "grouping key": "SELECT school, student_id, max(term_code) AS newest FROM guarded GROUP BY ALL",
    "two levels down": "SELECT z.k FROM (SELECT y.k FROM (SELECT student_id AS k FROM guarded) AS y) AS z",
    "named subquery": "WITH a AS (SELECT student_id AS k, school FROM guarded), b AS (TABLE a) TABLE b",
    "all columns": "TABLE guarded",
    "episode id": "SELECT max(term_code), program_episode_id FROM guarded GROUP BY 2",
    "in a struct": "SELECT named_struct('k', student_id, 's', school) AS s FROM guarded",
}
# Made from identifiers: these have no tag, their values tell.
REFUSED_BY_VALUE = {
    "lower case": "SELECT lower(student_id) AS k, school FROM guarded",
    "in a map": "SELECT map(student_id, school) AS m FROM guarded",
    "in a list": "SELECT school, collect_set(student_id) AS l FROM guarded GROUP BY school",
    "any one": "SELECT first(student_id) AS k FROM guarded",
    "joined to text": "SELECT concat(student_id, '') AS k FROM guarded",
    "in a sentence": "SELECT concat('about ', student_id, '.') AS k FROM guarded",
    "as bytes": "SELECT cast(student_id AS binary) AS k FROM guarded",
    "unpacked": "SELECT explode(array(student_id)) AS k FROM guarded",
    "over a window": "SELECT lag(student_id) OVER (ORDER BY term_code) AS k FROM guarded",
    "one side of a union": "SELECT school FROM guarded UNION ALL SELECT concat('', student_id) FROM guarded",
    "subquery value": "SELECT (SELECT any_value(student_id) FROM guarded) AS k",
    "part of the episode id": "SELECT concat(program_episode_id, '!') AS k FROM guarded",
}
ALLOWED = {
    "distinct heads": "SELECT school, count(DISTINCT student_id) AS heads FROM guarded GROUP BY ALL",
    "summaries": "SELECT count(student_id), avg(accumgpa), sum(creditenr), min(student_id), max(program_episode_id) FROM guarded",
    "no identifier": "SELECT pell, avg(accumgpa) AS gpa FROM guarded GROUP BY pell",
    "member test": "SELECT school FROM guarded WHERE program_episode_id IN "
                   "(SELECT program_episode_id FROM guarded GROUP BY program_episode_id HAVING count(*) > 3)",
    "joined on": "SELECT l.school, r.term_code FROM guarded l JOIN guarded r USING (student_id) LIMIT 5",
    "absence": "SELECT count(*) AS n FROM guarded o WHERE NOT EXISTS "
               "(SELECT * FROM guarded i WHERE i.student_id = o.student_id AND i.term_code > o.term_code)",
    "heads within a window": "SELECT count(*) OVER (PARTITION BY student_id) AS terms FROM guarded",
    "ordered by": "SELECT school FROM guarded ORDER BY student_id LIMIT 2",
    "counts of counts": "SELECT avg(n) AS terms FROM (SELECT student_id, count(*) AS n FROM guarded GROUP BY student_id)",
}


@pytest.mark.parametrize("case", REFUSED)
def test_refused(spark, fact, case):
    with pytest.raises(ReleaseRefused) as caught:
        release(spark.sql(REFUSED[case]))
    assert caught.value.reason == REFUSAL and caught.value.columns


@pytest.mark.parametrize("case", REFUSED_BY_VALUE)
def test_refused_by_value(spark, fact, case):
    with pytest.raises(ReleaseRefused) as caught:
        release(spark.sql(REFUSED_BY_VALUE[case]), fact.select("student_id"))
    assert caught.value.columns


def test_values_without_identifiers_pass(spark, fact):
    df = spark.sql("SELECT school, term_code, count(DISTINCT student_id) AS heads FROM guarded GROUP BY ALL")
    assert release(df, fact.select("student_id")) is df


@pytest.mark.parametrize("case", ALLOWED)
def test_allowed(spark, fact, case):
    df = spark.sql(ALLOWED[case])
    assert release(df) is df


def test_strip_keeps_the_rest(fact):
    kept = release_strip(fact.select("student_id", "program_episode_id", "school", "term_code"))
    assert kept.columns == ["school", "term_code"] and identifier_columns(kept) == []


def test_leak_scan_looks_into_values(spark):
    known = spark.createDataFrame([("s1",), ("S2",), (None,)], "student_id string")
    out = spark.createDataFrame(
        [("id S1", ["x", "s2"], {"k": "a S2 b"}, ("S1-U-BS-201510",), 1), ("s1", [], {"S1": ""}, ("none",), 2),
         ("s11", ["S1x"], None, None, 3), (None, None, None, None, 4)],
        "note string, list array<string>, pairs map<string,string>, inner struct<e: string>, n int")
    found = {r["column_name"]: r["leaked_rows"] for r in leak_scan(out, known).collect()}
    assert found == {"note": 2, "list": 1, "pairs": 2, "inner": 1}
    assert leak_scan(out.select("n"), known).count() == 0


def exchanged(plan, by: str) -> list[int]:
    """Rows that each exchange of a finished plan by the column ``by`` wrote."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    if "QueryStage" in plan.nodeName():
        below.append(plan.plan())
    found = [n for p in below for n in exchanged(p, by)]
    if plan.nodeName() == "Exchange" and f"hashpartitioning({by}#" in plan.outputPartitioning().toString():
        found.append(plan.metrics().apply("shuffleRecordsWritten").value())
    return found


def test_leak_scan_shuffles_only_words_like_identifiers(spark, monkeypatch):
    known = spark.range(50).selectExpr("concat('STU', lpad(id, 7, '0')) AS student_id")
    out = spark.range(400).selectExpr(
        "concat_ws(' ', 'term', '201510', 'of', 'STU' || lpad(id, 7, '0'), 'no', id) AS note", "'EN' AS school")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scan = leak_scan(out, known)
        want = [("note", 50), ("school", 0)]
        assert sorted(tuple(r) for r in scan.collect()) == want
        # Before, the words of all sentences went to the task of their word.
        assert max(exchanged(scan._jdf.queryExecution().executedPlan(), "word")) == 400
        monkeypatch.setattr("termwise.operators.governance.OUTLINES", 0)
        assert sorted(tuple(r) for r in leak_scan(out, known).collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_leak_scan_without_rows_or_identifiers(spark):
    out = spark.range(3).selectExpr("cast(id AS string) AS a", "cast(NULL AS string) AS b")
    none = spark.createDataFrame([], "student_id string")
    assert sorted(tuple(r) for r in leak_scan(out, none).collect()) == [("a", 0), ("b", 0)]
    assert leak_scan(out.limit(0), none).count() == 0
