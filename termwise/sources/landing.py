"""The staged enrollment file and the landing table behind it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The landing columns by position, their VARCHAR length, and
# whether they must be filled.
LANDING_COLUMNS = (
    ("student_id", 20, True),
    ("u_g", 1, True),
    ("gender", 10, False),
    ("school", 2, True),
    ("degtype", 10, False),
    ("firstgen", 1, False),
    ("pell", 1, False),
    ("ethnicmultirace", 5, False),
    ("citizen", 2, False),
    ("creditenr", 5, False),
    ("year_field", 4, False),
    ("semester", 10, False),
    ("academic_state", 30, False),
    ("regstat", 2, False),
    ("accumgpa", 10, False),
    ("term_code", 6, True),
)
LANDING_NAMES = [name for name, _, _ in LANDING_COLUMNS]
# Text that stands for NULL in the staged file.
NULL_TOKENS = ("", "NULL", "null")


STAGED_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in LANDING_NAMES])


def scan_staged(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    """The staged CSV as text columns, bound by position, nothing loaded yet.

    Header names are ignored, a short line leaves its last columns NULL, and
    each of the three null tokens reads as NULL. ``line_fault`` says what is
    wrong with a line that has more fields than there are columns. ``with_file``
    adds the path of the file each row came from.
    """
    raw = (
        spark.read.schema(T.StructType([*STAGED_SCHEMA.fields, T.StructField("_line", T.StringType())]))
        .option("columnNameOfCorruptRecord", "_line")
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
    file = ["_metadata.file_path AS source_file"] if with_file else []
    # The line itself is kept only where its fields do not match the columns; commas in quotes part nothing.
    fields = "regexp_count(regexp_replace(_line, '\"[^\"]*\"', ''), ',') + 1"
    fault = f"CASE WHEN {fields} > {len(LANDING_NAMES)} THEN 'more than {len(LANDING_NAMES)} fields' END AS line_fault"
    return raw.selectExpr(*[f"CASE WHEN {c} NOT IN ({tokens}) THEN {c} END AS {c}" for c in LANDING_NAMES], fault, *file)


def rejection_reason(staged: DataFrame | None = None) -> Column:
    """First fault of a line or landing constraint a row breaks, or NULL when it may be loaded."""
    checks = [F.col("line_fault")] if staged is not None and "line_fault" in staged.columns else []
    checks += [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c, _, needed in LANDING_COLUMNS if needed]
    checks += [F.when(F.length(c) > size, F.lit(f"{c} too long")) for c, size, _ in LANDING_COLUMNS]
    return F.coalesce(*checks)


@dataclass
class LandingSplit:
    accepted: DataFrame
    rejected: DataFrame


def split_by_constraints(staged: DataFrame) -> LandingSplit:
    """Keep the good rows and set the bad ones aside with the reason."""
    judged = staged.withColumn("reject_reason", rejection_reason(staged))
    return LandingSplit(
        accepted=judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        rejected=judged.filter(F.col("reject_reason").isNotNull()),
    )


def load_landing(staged: DataFrame, table_path: str, full_refresh: bool = False) -> None:
    """Append the accepted rows with ``loaded_at``, or replace the table first."""
    accepted = split_by_constraints(staged).accepted
    (
        accepted.select(*LANDING_NAMES)
        .withColumn("loaded_at", F.current_timestamp())
        .write.mode("overwrite" if full_refresh else "append")
        .parquet(table_path)
    )


def load_report(staged: DataFrame, landing: DataFrame, by_file: bool = False) -> DataFrame:
    """Rows parsed, loaded and rejected, per file or in all, and the table's row count."""
    bad = rejection_reason(staged).isNotNull()
    return staged.groupBy(*(["source_file"] if by_file else [])).agg(
        F.count(F.lit(1)).alias("rows_parsed"),
        F.count_if(~bad).alias("rows_loaded"),
        F.count_if(bad).alias("rows_rejected"),
    ).withColumn("table_rows", landing.agg(F.count(F.lit(1))).scalar())
