import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from termwise import inputs
from termwise.plans import headcounts, semantic
from termwise.plans.staging import typed_enrollment


def test_numbers_are_dense(spark, monkeypatch):
    ids = [(f"S{i}",) for i in range(700)] + [("S3",)] * 50 + [(None,)]
    frame = spark.createDataFrame(ids, "student_id string").repartition(5)
    for cells in (1, 3, 4096):
        monkeypatch.setattr(headcounts, "CELLS", cells)
        got = [tuple(r) for r in headcounts.student_numbers(frame).collect()]
        assert sorted(n for _, n in got) == list(range(700)) and len({s for s, _ in got}) == 700
    assert headcounts.student_numbers(frame.limit(0)).count() == 0


def test_every_subset_equals_the_distinct_count(spark, enrollment):
    rng = random.Random(2)
    rows = enrollment([(f"S{rng.randrange(40)}", rng.choice(["201910", "201990"]), "Enrolled", "1",
                        {"school": rng.choice(["EN", "AD", None]), "pell": rng.choice(["Y", "N"]), "firstgen": "Y",
                         "creditenr": rng.choice(["3", "12", None])}) for _ in range(200)])
    numbers = headcounts.student_numbers(rows).withColumn("number", F.col("number") * 40_000)
    stored = headcounts.headcount_bitmaps(rows, numbers)
    flags = {"pell_student_count": "pell = 'Y'", "full_time_students": "creditenr >= 12", "part_time_students": "creditenr < 12",
             "firstgen_enrollment_count": "firstgen = 'Y'"}
    for k in range(3):
        for by in itertools.combinations(("term_code", "school", "pell"), k):
            want = semantic.student_heads(rows, list(by), flags)
            got = headcounts.headcounts(stored, list(by))
            key = lambda r: repr(sorted(r.items()))
            assert sorted((r.asDict() for r in got.collect()), key=key) == sorted((r.asDict() for r in want.collect()), key=key)


def test_empty_enrollment(spark, enrollment):
    rows = enrollment([("S1", "201910", "Enrolled", "1")]).limit(0)
    stored = headcounts.headcount_bitmaps(rows, headcounts.student_numbers(rows))
    assert headcounts.headcounts(stored, ["school"]).count() == 0
    assert headcounts.headcounts(stored, []).first()["student_count"] == 0


@pytest.mark.parametrize("dims", [["u_g"], ["u_g", "school", "pell"]])
def test_rate_cube_reads_its_fact_once(spark, tmp_path, dims):
    typed_enrollment(inputs.lnd(spark, SF_DIR)).groupBy("u_g", "school", "pell").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("academic_state") == "Graduated").alias("g")).write.parquet(str(tmp_path / "f"))
    fact = spark.read.parquet(str(tmp_path / "f"))
    cube = semantic.rate_cube(fact, dims, "g", "n", "rate")
    assert cube._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = cube.collect()
    total = fact.agg(F.sum("g"), F.sum("n")).first()
    top = next(r for r in rows if r.grouping_id == 2 ** len(dims) - 1)
    assert (top.g, top.n) == tuple(total) and {r.grouping_id for r in rows} == set(range(2 ** len(dims)))


def test_bitmaps_are_made_after_the_shuffle(spark, enrollment):
    rows = enrollment([(f"S{i}", "201910", "Enrolled", "1", {"school": "EN"}) for i in range(20)])
    stored = headcounts.headcount_bitmaps(rows, headcounts.student_numbers(rows))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    # Before, each task made bitmaps of its own, and an exchange lay between two aggregates of them.
    partial, final = (plan.index(x) for x in ("partial_bitmap_construct_agg", "bitmap_construct_agg"))
    assert final < partial and "Exchange" not in plan[final:partial]
    assert [r.n for r in stored.selectExpr("bitmap_count(students) AS n").collect()] == [20]
