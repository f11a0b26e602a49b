"""Layered storage, stable views, audit columns, the day spine and text files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LAYER = "REPORT"
# The spine's first day and length.
SPINE_START, SPINE_DAYS = "2015-01-01", 5479


AUDIT_COLUMNS = ("loaded_at", "updated_at", "updated_by")


def with_audit(df: DataFrame) -> DataFrame:
    """Stamp when and by whom a table was built."""
    return (
        df.withColumn("loaded_at", F.current_timestamp())
        .withColumn("updated_at", F.current_timestamp())
        .withColumn("updated_by", F.current_user())
    )


@dataclass
class LayerStore:
    """Parquet tables under ``root/LAYER/name``; the layer name is used verbatim."""

    spark: SparkSession
    root: str

    def path(self, name: str, layer: str | None = None) -> str:
        return f"{self.root.rstrip('/')}/{(layer or DEFAULT_LAYER).strip()}/{name}"

    def replace(self, df: DataFrame, name: str, layer: str | None = None, spread_by: tuple[str, ...] = (),
                finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Rebuild one table in full and return it as read back.

        ``spread_by`` columns become folders. The rebalance hint gathers each
        folder into few files and lets adaptive execution split a folder that
        holds an outsized share of the rows. ``finish`` adds what follows from a row
        alone, after the rows have moved.
        """
        out = df.hint("rebalance", *spread_by) if spread_by else df
        out = finish(out) if finish else out
        writer = out.write.mode("overwrite")
        if spread_by:
            writer = writer.partitionBy(*spread_by)
        writer.parquet(self.path(name, layer))
        return self.read(name, layer).select(*out.columns)

    def read(self, name: str, layer: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self.path(name, layer))


# The stable view names and the tables they pass through.
REPORT_VIEWS = {
    "vw_dim_program_episode": ("REPORT", "dim_program_episode"),
    "vw_fct_enrollment_term": ("REPORT", "fct_enrollment_term"),
    "vw_fct_graduation_rate": ("REPORT", "fct_graduation_rate"),
    "vw_fct_retention_rate_cohort": ("REPORT", "fct_retention_rate_cohort"),
    "vw_fct_graduation_rate_term": ("REPORT", "fct_graduation_rate_term"),
    "vw_fct_retention_rate_term": ("REPORT", "fct_retention_rate_term"),
    "vw_stg_student_enrollment": ("STG", "stg_student_enrollment"),
}
STALE_VIEWS = ("vw_fct_enrollment_by_semester_level", "fct_enrollment_by_semester_level", "fct_attrition_rate")


def create_report_views(tables: dict[str, DataFrame]) -> list[str]:
    """Register the pass-through views over built tables; returns the names made."""
    made = []
    for view, (_, table) in REPORT_VIEWS.items():
        if table in tables:
            tables[table].createOrReplaceTempView(view)
            made.append(view)
    return made


def drop_stale_views(spark: SparkSession) -> None:
    for name in STALE_VIEWS:
        spark.catalog.dropTempView(name)


def time_spine(spark: SparkSession, start: str = SPINE_START, days: int = SPINE_DAYS) -> DataFrame:
    """One row per calendar day."""
    return spark.range(days).select(
        F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date_day")
    )


def text_documents(spark: SparkSession, path: str, with_file: bool = False) -> DataFrame:
    """Whole text files as ``(source, text)``, the source being the file name.

    Spark packs many small files into a task. ``with_file`` adds the path of the
    file and when it was last changed.
    """
    file = ["_metadata.file_path AS path", "_metadata.file_modification_time AS modified"] if with_file else []
    return spark.read.text(path, wholetext=True).selectExpr(
        "element_at(split(_metadata.file_path, '/'), -1) AS source", "value AS text", *file)


# Fixed value: ends a document in a file of many.
DOCUMENT_END = "\x1e"


def write_text_documents(docs: DataFrame, path: str) -> None:
    """(source, text) as text files of many documents: each its source's line, its text and a line end.

    A folder and a file for each document would cost more than the texts. ``~0`` stands for ``~`` and ``~1`` for
    the character that ends a document, so any text comes back as it was; line ends in a source do not occur.
    """
    record = F.concat(F.col("source").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n"))
    safe = F.replace(F.replace(record, F.lit("~"), F.lit("~0")), F.lit(DOCUMENT_END), F.lit("~1"))
    docs.filter("source IS NOT NULL AND text IS NOT NULL").select(safe.alias("value")).write.option(
        "lineSep", DOCUMENT_END).text(path)


def packed_documents(spark: SparkSession, path: str) -> DataFrame:
    """What `write_text_documents` wrote, each document whole, with its file's path and time of change."""
    record = F.replace(F.replace("value", F.lit("~1"), F.lit(DOCUMENT_END)), F.lit("~0"), F.lit("~"))
    return spark.read.text(path, lineSep=DOCUMENT_END).select(
        record.alias("record"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).select(
        F.substring_index("record", "\n", 1).alias("source"),
        F.expr("substring(record, instr(record, '\n') + 1)").alias("text"), "path", "modified")
