"""Every registered query against its SQL, and plan shapes that must hold."""

import pytest

import __spark_entry__ as entry
import compare
from conftest import SF_DIR
from termwise.checks.queries import QUERIES, Tables
from termwise.plans import facts

WITHOUT_SQL = set()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_registry_is_complete():
    assert set(QUERIES) - set(entry.oracle_sql()) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    query = entry.queries()[name]
    if name in WITHOUT_SQL:
        assert query(spark, SF_DIR).count() > 0
    else:
        assert compare.compare(spark, duck, name, query, entry.oracle_sql()[name], SF_DIR) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["int_program_episodes", "fct_graduation_rate", "fct_retention_rate_term",
                                  "fct_enrollment_term", "graduation_term_eligible", "leak_scan", "semi_in"])
def test_no_cross_join(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_term_facts_shuffle_the_rows_once(spark, tmp_path):
    t = Tables(spark, SF_DIR)
    t.typed.write.parquet(str(tmp_path / "stg"))
    t.calendar.write.parquet(str(tmp_path / "cal"))
    fact = facts.fct_retention_rate_term(spark.read.parquet(str(tmp_path / "stg")),
                                         spark.read.parquet(str(tmp_path / "cal")))
    # One shuffle of entries by episode key, one of the small group totals.
    assert _plan(fact).count("Exchange hashpartitioning") == 2


def test_scan_reads_only_what_is_asked(spark, tmp_path):
    Tables(spark, SF_DIR).typed.write.parquet(str(tmp_path / "stg"))
    from termwise.plans.semantic import student_heads

    plan = _plan(student_heads(spark.read.parquet(str(tmp_path / "stg")).filter("u_g = 'G'"), ["term_code"], {}))
    assert "ReadSchema: struct<student_id:string,u_g:string,term_code:string>" in plan
    assert "EqualTo(u_g,G)" in plan
