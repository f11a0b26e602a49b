import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SF_DIR
from termwise import inputs
from termwise.operators.governance import ReleaseRefused, release
from termwise.plans import build
from termwise.sources.catalog import CatalogStore
from termwise.sources.layers import REPORT_VIEWS


@pytest.fixture
def store(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "wh"), f"t{abs(hash(str(tmp_path)))}")
    yield store
    for layer in ("STG", "REPORT", "LND"):
        spark.sql(f"DROP DATABASE IF EXISTS {store.database(layer)} CASCADE")


def stored(spark, store, layer):
    return sorted(r.tableName for r in spark.sql(f"SHOW TABLES IN {store.database(layer)}").collect())


def files(store):
    import pathlib

    return {p for p in pathlib.Path(store.root).rglob("*.parquet")}


def test_a_new_build_replaces_the_old_one_and_its_files(spark, store):
    with store.rebuild():
        store.replace(spark.range(3), "a")
        store.replace(spark.range(9).selectExpr("id", "id % 2 AS part"), "b", "STG", ("part",))
    first, view = files(store), store.read("a")
    assert view.count() == 3 and store.read("b", "STG").count() == 9
    with store.rebuild():
        store.replace(spark.range(5), "a")
    # Only what was rebuilt is replaced.
    assert store.read("a").count() == 5 and store.read("b", "STG").count() == 9
    assert len(stored(spark, store, "REPORT")) == 2 and not first <= files(store)


def test_a_rebuild_that_breaks_leaves_the_former_tables(spark, store):
    with store.rebuild():
        store.replace(spark.range(3), "a")
        store.replace(spark.range(4), "b")
    before = stored(spark, store, "REPORT")
    with pytest.raises(PySparkException):
        with store.rebuild():
            store.replace(spark.range(30), "a")
            store.replace(spark.range(2).select(F.raise_error(F.lit("broken"))), "b")
    with pytest.raises(KeyboardInterrupt):
        with store.rebuild():
            store.replace(spark.range(30), "a")
            raise KeyboardInterrupt
    assert store.read("a").count() == 3 and store.read("b").count() == 4
    assert stored(spark, store, "REPORT") == before
    with pytest.raises(RuntimeError):
        store.replace(spark.range(1), "a")


def test_views_and_stale_objects(spark, store):
    tables = build.rebuild(inputs.lnd(spark, SF_DIR), store)
    spark.sql(f"CREATE TABLE {store.name('fct_attrition_rate')} USING parquet AS SELECT 1 AS x")
    spark.sql(f"CREATE VIEW {store.name('vw_fct_enrollment_by_semester_level')} AS SELECT 1 AS x")
    store.drop_stale()
    names = stored(spark, store, "REPORT")
    assert set(REPORT_VIEWS) <= set(names) and not {"fct_attrition_rate", "vw_fct_enrollment_by_semester_level"} & set(names)
    for view, (_, table) in REPORT_VIEWS.items():
        assert spark.table(store.name(view)).count() == tables[table].count() > 0
    # The tables read through views still refuse to show whom they are about.
    with pytest.raises(ReleaseRefused):
        release(tables["fct_enrollment_term"].select("student_id", "school"))
    # A question about one year reads one folder.
    plan = spark.table(store.name("vw_fct_enrollment_term")).filter("term_year = 2019")
    assert "PartitionFilters: [isnotnull(term_year" in plan._jdf.queryExecution().executedPlan().toString()
