"""Distinct students from stored bitmaps, at any subset of the dimensions.

Counts of distinct students do not add up over groups; sets of them do. Each
student gets a number, dense from 0, and each finest group of the enrollment
fact keeps the numbers it has seen, as bitmaps of ``BITS`` consecutive numbers.
A question at any grouping, or at all of them at once, ORs what is stored and
counts the bits: exact, and without the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termwise.plans.facts import enrollment_rows

# Bits of one bitmap, as Spark's bitmap functions lay them out.
BITS = 32768
CELLS = 4096
DIMENSIONS = ("term_code", "u_g", "school", "gender", "pell", "firstgen", "full_time")
MEASURES = {
    "student_count": "true", "pell_student_count": "pell = 'Y'", "firstgen_enrollment_count": "firstgen = 'Y'",
    "full_time_students": "full_time", "part_time_students": "NOT full_time",
}


def student_numbers(enrollment: DataFrame) -> DataFrame:
    """(student_id, number): every student once, numbered from 0 without a gap.

    Students are dealt to cells of cells by their hash; each level counts its own
    cells only, so no task sees more than ``CELLS`` counts or one cell's students.
    """
    hashed = F.xxhash64("student_id")
    dealt = enrollment.filter("student_id IS NOT NULL").select("student_id").distinct().select(
        "student_id", F.pmod(hashed, F.lit(CELLS)).alias("outer"),
        F.pmod(F.shiftright(hashed, 32), F.lit(CELLS)).alias("inner"))
    cells = dealt.groupBy("outer", "inner").agg(F.count(F.lit(1)).alias("n"))

    def before(order: str, *within: str):
        return F.coalesce(F.sum("n").over(
            Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    outer = cells.groupBy("outer").agg(F.sum("n").alias("n")).select("outer", before("outer").alias("outer_start"))
    starts = cells.withColumn("inner_start", before("inner", "outer")).drop("n").join(outer, "outer")
    place = F.row_number().over(Window.partitionBy("outer", "inner").orderBy("student_id")) - 1
    return dealt.withColumn("place", place).join(starts, ["outer", "inner"]).select(
        "student_id", (F.col("outer_start") + F.col("inner_start") + F.col("place")).alias("number"))


def headcount_bitmaps(enrollment: DataFrame, numbers: DataFrame) -> DataFrame:
    """(dimensions, part, students): per finest group the bitmaps of the students it has."""
    rows = enrollment_rows(enrollment).withColumn("full_time", F.expr("creditenr >= 12"))
    numbered = rows.select(*DIMENSIONS, "student_id").distinct().join(numbers, "student_id").withColumn(
        "bit", F.col("number") + 1).withColumn("part", F.expr("bitmap_bucket_number(bit)"))
    # The numbers travel, at most BITS a part, and each bitmap is made once: a task's own bitmaps would be
    # 4 KB for a few bits each, and all of them sorted again.
    return numbered.repartition(*DIMENSIONS, "part").groupBy(*DIMENSIONS, "part").agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("students"))


def _counted(parts: DataFrame, by: list[str], measures: dict[str, str]) -> DataFrame:
    return parts.groupBy(*by).agg(*[F.expr(f"coalesce(sum({name}), 0)").alias(name) for name in measures])


def _unions(measures: dict[str, str]) -> list:
    return [F.expr(f"bitmap_count(bitmap_or_agg(CASE WHEN {where} THEN students END))").alias(name)
            for name, where in measures.items()]


def headcounts(bitmaps: DataFrame, by: list[str], measures: dict[str, str] = MEASURES) -> DataFrame:
    """Distinct students at the grouping ``by``; a measure's SQL condition reads dimensions."""
    return _counted(bitmaps.groupBy(*by, "part").agg(*_unions(measures)), by, measures)


def headcount_cube(bitmaps: DataFrame, by: list[str], measures: dict[str, str] = MEASURES) -> DataFrame:
    """Distinct students at every subset of ``by``; ``grouping_id`` has a bit for each dimension left out.

    The bitmaps of the finest grouping asked for are made first, so that only they are spread over the subsets.
    """
    sets = bitmaps.groupBy(*by, "part").agg(*[
        F.expr(f"bitmap_or_agg(CASE WHEN {where} THEN students END)").alias(name) for name, where in measures.items()])
    grouped = sets.cube(*by, "part").agg(
        F.grouping_id().alias("_id"), *[F.expr(f"bitmap_count(bitmap_or_agg({name}))").alias(name) for name in measures])
    # The last bit says that parts were left out; only sums over the parts count.
    parts = grouped.filter("_id % 2 = 0").withColumn("grouping_id", F.expr("_id div 2"))
    return _counted(parts, ["grouping_id", *by], measures)
