import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from termwise import inputs
from termwise.operators import quality
from termwise.sources import landing, loads

GOOD = "S{i},U,Female,EN,BS,Y,Y,1,1,12,2019,Fall,Enrolled,1,3.00,201990"


def write(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(["header", *lines]) + "\n")


def per_file(loaded):
    return sorted((r.path.rsplit("/", 1)[1], r.rows_parsed, r.rows_loaded, r.rows_rejected) for r in loaded.report.collect())


@pytest.fixture
def table(spark, tmp_path):
    return loads.LandingTable(spark, str(tmp_path / "lnd"))


def test_the_same_folder_twice(table, tmp_path):
    folder = tmp_path / "staged files"
    write(folder, "a b.csv", GOOD.format(i=1), GOOD.format(i=2).replace(",1,1,", ",1,333,"))
    write(folder, "c.csv", GOOD.format(i=3))
    write(folder, "empty.csv")
    first = table.append_files(str(folder))
    assert per_file(first) == [("a%20b.csv", 2, 1, 1), ("c.csv", 1, 1, 0), ("empty.csv", 0, 0, 0)]
    again = table.append_files(str(folder))
    assert again.load_id is None and again.report.count() == 0 and table.read().count() == 2
    assert [(r.student_id, r.reject_reason) for r in table.rejects().collect()] == [("S2", "citizen too long")]
    # A new file is loaded, the others are not; a changed one is new.
    write(folder, "d.csv", GOOD.format(i=4))
    assert per_file(table.append_files(str(folder))) == [("d.csv", 1, 1, 0)]
    write(folder, "c.csv", GOOD.format(i=5), GOOD.format(i=6))
    assert per_file(table.append_files(str(folder))) == [("c.csv", 2, 2, 0)]
    assert sorted(r.student_id for r in table.read().collect()) == ["S1", "S3", "S4", "S5", "S6"]
    assert table.read().columns == [*landing.LANDING_NAMES, "loaded_at"]


def test_refresh_replaces_all_and_forgets_old_files(table, tmp_path):
    write(tmp_path / "one", "a.csv", GOOD.format(i=1))
    write(tmp_path / "two", "b.csv", GOOD.format(i=2))
    table.append_files(str(tmp_path / "one"))
    table.refresh_files(str(tmp_path / "two"))
    assert [r.student_id for r in table.read().collect()] == ["S2"]
    assert per_file(table.append_files(str(tmp_path / "one"))) == [("a.csv", 1, 1, 0)]
    table.refresh_files(str(tmp_path / "one"))
    assert [r.student_id for r in table.read().collect()] == ["S1"] and table.ledger().count() == 1


def test_a_blocked_or_broken_load_is_never_seen(table, tmp_path, spark, monkeypatch):
    write(tmp_path / "good", "a.csv", GOOD.format(i=1))
    table.append_files(str(tmp_path / "good"))
    write(tmp_path / "bad", "b.csv", GOOD.format(i=2), GOOD.format(i=2), GOOD.format(i=3).replace(",EN,", ",ZZ,"))
    with pytest.raises(quality.GateBlocked) as caught:
        table.append_files(str(tmp_path / "bad"))
    assert {c["check_no"]: c["value"] for c in caught.value.checks if c["status"] == "FAIL"} == {4: 1, 6: 1}
    monkeypatch.setattr(quality, "duplicate_groups", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.refresh_files(str(tmp_path / "bad"))
    assert [r.student_id for r in table.read().collect()] == ["S1"]


def test_gate_values_are_those_of_the_separate_checks(spark, table):
    staged = inputs.staged(spark, SF_DIR)
    want = {r["check_no"]: (r["name"], r["value"], r["status"]) for r in quality.qc_checks(staged).collect()}
    with pytest.raises(quality.GateBlocked) as caught:
        table.load(staged)
    assert {c["check_no"]: (c["name"], c["value"], c["status"]) for c in caught.value.checks} == want
    assert table.read().count() == 0 and table.ledger().count() == 0


def test_staged_rows_are_read_once(spark, table):
    seen = spark.sparkContext.accumulator(0)
    rows = inputs.lnd(spark, SF_DIR).withColumn("citizen", F.when(F.col("citizen") == "3", "333").otherwise(F.col("citizen")))

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    loaded = table.load(rows.mapInPandas(count, rows.schema))
    table.read().count(), table.rejects().count(), loaded.report.collect()
    assert seen.value == rows.count()
    line = loaded.report.first()
    assert (line.rows_parsed, line.rows_rejected) == (rows.count(), rows.filter("citizen = '333'").count())


def test_fields_are_counted_outside_quotes(spark, tmp_path):
    line = GOOD.format(i=1)
    write(tmp_path / "f", "a.csv", line + ',"a,""b"",c"', line.replace("Enrolled", '"a, ""b"", c"'), "x" * 100_000 + "," * 40)
    staged = landing.scan_staged(spark, str(tmp_path / "f")).collect()
    assert [r.line_fault for r in staged] == ["more than 16 fields", None, "more than 16 fields"]
    assert staged[1].academic_state == 'a, "b", c'
