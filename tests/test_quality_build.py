import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from termwise import inputs
from termwise.operators import datatests, quality
from termwise.operators.governance import ReleaseRefused, release
from termwise.plans import build
from termwise.plans.staging import cast_rejects
from termwise.sources import landing, layers


def test_gate_blocks_a_bad_file(spark):
    with pytest.raises(quality.GateBlocked) as caught:
        quality.require_pass(inputs.staged(spark, SF_DIR))
    assert "no duplicate rows" in str(caught.value)


def test_gate_values(spark):
    got = {r["check_no"]: r["value"] for r in quality.qc_checks(inputs.staged(spark, SF_DIR)).collect()}
    assert got == {1: 1178, 2: 27, 3: 25, 4: 12, 5: 27, 6: 5, 7: 28, 8: 32, 9: 34}


def test_empty_file_fails_the_first_check(spark):
    empty = spark.createDataFrame([], landing.STAGED_SCHEMA)
    status = {r["check_no"]: r["status"] for r in quality.qc_checks(empty).collect()}
    assert status.pop(1) == "FAIL" and set(status.values()) == {"PASS"}


def test_null_passes_value_lists(spark):
    row = [None] * len(landing.LANDING_NAMES)
    got = {r["check_no"]: r["value"] for r in quality.qc_checks(
        spark.createDataFrame([row], landing.STAGED_SCHEMA)).collect()}
    assert got[2] == 1 and all(got[n] == 0 for n in (3, 4, 5, 6, 7, 8, 9))


def test_scan_binds_by_position(spark, tmp_path):
    line = 'S1,U,Male,"E,N",BS,NULL,null,,1,12,2020,Fall,Enrolled,1,3.1,202010'
    (tmp_path / "f.csv").write_text("\n".join([",".join(f"h{i}" for i in range(16)), line, "S2,U,Male,EN"]) + "\n")
    got = {r["student_id"]: r for r in landing.scan_staged(spark, str(tmp_path / "f.csv")).collect()}
    assert got["S1"]["school"] == "E,N" and got["S1"]["term_code"] == "202010"
    assert (got["S1"]["firstgen"], got["S1"]["pell"], got["S1"]["ethnicmultirace"]) == (None, None, None)
    # A short line is kept with NULLs, then refused by the landing constraints.
    split = landing.split_by_constraints(landing.scan_staged(spark, str(tmp_path / "f.csv")))
    assert [(r["student_id"], r["reject_reason"]) for r in split.rejected.collect()] == [
        ("S1", "school too long"), ("S2", "term_code is null")]


def test_report_per_file(spark, tmp_path):
    good = "S1,U,Male,EN,BS,Y,Y,1,1,12,2020,Fall,Enrolled,1,3.1,202010"
    for name, lines in {"a.csv": [good, "S2,U"], "b.csv": [good]}.items():
        (tmp_path / name).write_text("\n".join(["header", *lines]) + "\n")
    staged = landing.scan_staged(spark, str(tmp_path), with_file=True)
    loaded = landing.split_by_constraints(staged).accepted
    got = sorted((r[0].rsplit("/", 1)[1], *r[1:]) for r in landing.load_report(staged, loaded, by_file=True).collect())
    assert got == [("a.csv", 2, 1, 1, 2), ("b.csv", 1, 1, 0, 2)]


def test_append_and_full_refresh(spark, tmp_path):
    rows, path = inputs.lnd(spark, SF_DIR), str(tmp_path / "lnd")
    landing.load_landing(rows, path)
    landing.load_landing(rows, path)
    assert spark.read.parquet(path).count() == 2320
    landing.load_landing(rows, path, full_refresh=True)
    stored = spark.read.parquet(path)
    assert stored.count() == 1160 and stored.columns == [*landing.LANDING_NAMES, "loaded_at"]


def test_cast_rejects_are_counted(enrollment, spark):
    row = dict.fromkeys(landing.LANDING_NAMES)
    bad = [{**row, "creditenr": "x", "accumgpa": "123.4"}, {**row, "creditenr": "3.6", "accumgpa": "3.1"}]
    df = spark.createDataFrame([[r[n] for n in landing.LANDING_NAMES] for r in bad], landing.STAGED_SCHEMA)
    assert tuple(cast_rejects(df).first()) == (1, 1)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    store = layers.LayerStore(spark, str(tmp_path_factory.mktemp("layers")))
    return store, build.build(inputs.lnd(spark, SF_DIR), store)


def test_build_passes_all_declared_tests(built):
    _, result = built
    failures = {(r["model"], r["test"], r["column_name"]): r["failures"] for r in result.tests.collect()}
    assert len(datatests.DECLARED_TESTS) == 45 == len(failures)
    assert set(failures.values()) == {0}


def test_layers_views_and_audit(built, spark):
    store, result = built
    assert store.path("x", "STG").endswith("/STG/x") and store.path("x").endswith("/REPORT/x")
    for view, (_, table) in layers.REPORT_VIEWS.items():
        assert spark.table(view).count() == result.tables[table].count()
    stored = store.read("dim_program_episode", "REPORT")
    assert {"loaded_at", "updated_at", "updated_by"} <= set(stored.columns)
    # A question about one year reads one folder.
    plan = store.read("fct_enrollment_term", "REPORT").filter("term_year = 2019")
    assert "PartitionFilters: [isnotnull(term_year" in plan._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_refuse_raw_identifiers(built, spark):
    _, result = built
    with pytest.raises(ReleaseRefused):
        release(result.tables["fct_enrollment_term"].select("student_id", "school"))
    release(result.tables["fct_enrollment_term"].groupBy("school").count())


def test_build_reports_what_the_load_left_out(spark, tmp_path):
    rows = inputs.lnd(spark, SF_DIR)
    rows = rows.withColumn("citizen", F.when(F.col("citizen") == "3", "333").otherwise(F.col("citizen")))
    result = build.build(rows, layers.LayerStore(spark, str(tmp_path)))
    parsed, loaded, rejected, stored = result.report.first()
    assert rejected == rows.filter("citizen = '333'").count() > 0
    assert (parsed, loaded, stored) == (rows.count(), parsed - rejected, loaded)
    assert result.rejects.count() == rejected
    assert {r[0] for r in result.rejects.select("reject_reason").distinct().collect()} == {"citizen too long"}


def test_lines_with_too_many_fields_are_rejected(spark, tmp_path):
    line = "S1,U,Female,EN,BS,Y,Y,1,1,12,2019,Fall,Enrolled,1,3.00,201990"
    (tmp_path / "a.csv").write_text("\n".join([
        "header", line, line + ",x", line + ",,y", line + ",,", line.replace("Enrolled", '"a, b"'), "S2,U,Female,EN"]))
    split = landing.split_by_constraints(landing.scan_staged(spark, str(tmp_path)))
    assert [r.academic_state for r in split.accepted.orderBy("academic_state").collect()] == ["Enrolled", "a, b"]
    reasons = sorted(r.reject_reason for r in split.rejected.collect())
    assert reasons == ["more than 16 fields"] * 3 + ["term_code is null"]


def test_stale_views_are_dropped(spark):
    spark.range(1).createOrReplaceTempView("fct_attrition_rate")
    layers.drop_stale_views(spark)
    assert not spark.catalog.tableExists("fct_attrition_rate")


def test_text_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    assert [tuple(r) for r in layers.text_documents(spark, str(tmp_path)).collect()] == [("a.txt", "one\n\ntwo")]


def test_spine(spark):
    days = layers.time_spine(spark).selectExpr("count(*)", "min(date_day)", "max(date_day)").first()
    assert (days[0], str(days[1]), str(days[2])) == (5479, "2015-01-01", "2029-12-31")


def test_build_gathers_entries_once_and_moves_narrow_rows(spark, tmp_path):
    from termwise.plans.build import build_tables

    plans, moved = {}, set()

    class Store(layers.LayerStore):
        def replace(self, df, name, layer=None, spread_by=(), finish=None):
            moved.update(df.columns)
            plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
            return super().replace(df, name, layer, spread_by, finish)

    tables = build_tables(inputs.lnd_with_edge(spark, SF_DIR), Store(spark, str(tmp_path)))
    assert [name for name, plan in plans.items() if "collect_set" in plan] == ["int_program_entries"]
    # What the rebalance moves has neither descriptions nor audit columns.
    assert "school_name" not in plans["stg_student_enrollment"]
    assert not {"loaded_at", "updated_at", "updated_by"} & moved
    assert {"school_name", "ethnicity_description"} <= set(tables["stg_student_enrollment"].columns)
    assert not {"loaded_at", "updated_by"} & set(tables["stg_student_enrollment"].columns)
