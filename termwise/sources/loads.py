"""Loading the landing table: once per file, gated and reported by one read of the staged rows.

A load writes every staged row, accepted or rejected, under its own ``load_id``
and observes the quality checks on the way. The rows do not count until the
load's lines are in the ledger, which is the last step and one append: a load
that the gate blocks, or that dies half way, is never seen. A full refresh is a
line that makes all earlier loads void.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termwise.operators import quality
from termwise.sources.landing import LANDING_NAMES, STAGED_SCHEMA, rejection_reason, scan_staged

LEDGER_SCHEMA = ("load_id string, full_refresh boolean, path string, size long, modified timestamp, "
                 "rows_parsed long, rows_loaded long, rows_rejected long")
_FILE = ["path", "size", "modified"]


@dataclass
class Loaded:
    """What one load did: its id, the nine checks, and rows per file; no id where there was nothing new."""

    load_id: str | None
    checks: list
    report: DataFrame


@dataclass
class LandingTable:
    """Landing rows under ``path``/rows and the ledger of the loads that count under ``path``/ledger."""

    spark: SparkSession
    path: str

    def _table(self, name: str, schema: str, *parts: str) -> DataFrame:
        at = f"{self.path.rstrip('/')}/{name}"
        writer = self.spark.createDataFrame([], schema).write.mode("ignore")
        (writer.partitionBy(*parts) if parts else writer).parquet(at)
        return self.spark.read.schema(schema).parquet(at)

    def _rows(self) -> DataFrame:
        fields = T.StructType([*STAGED_SCHEMA.fields, T.StructField("source_file", T.StringType()),
                               T.StructField("reject_reason", T.StringType()), T.StructField("loaded_at", T.TimestampType()),
                               T.StructField("load_id", T.StringType()), T.StructField("outcome", T.StringType())])
        return self._table("rows", fields, "load_id", "outcome")

    def ledger(self) -> DataFrame:
        """Per file of each load that counts: its size, time and rows. A load without files has one line."""
        lines = self._table("ledger", LEDGER_SCHEMA)
        since = lines.filter("full_refresh").agg(F.max("load_id")).scalar()
        return lines.filter(F.col("load_id") >= F.coalesce(since, F.lit("")))

    def _counted(self, outcome: str) -> DataFrame:
        loads = self.ledger().select("load_id").distinct()
        return self._rows().filter(F.col("outcome") == outcome).join(loads, "load_id", "left_semi")

    def read(self) -> DataFrame:
        return self._counted("accepted").select(*LANDING_NAMES, "loaded_at")

    def rejects(self) -> DataFrame:
        return self._counted("rejected").select(*LANDING_NAMES, "source_file", "reject_reason")

    def _files(self, folder: str) -> DataFrame:
        """Name, size and time of the folder's files; what is in them is not read."""
        return self.spark.read.format("binaryFile").load(folder).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"), F.col("path").alias("at"))

    def new_files(self, folder: str) -> DataFrame:
        """The files of a folder that no load that counts has read as they are now."""
        return self._files(folder).join(self.ledger().filter("path IS NOT NULL").select(*_FILE), _FILE, "left_anti")

    def append_files(self, folder: str) -> Loaded:
        """Load the files that have not been loaded yet; the same folder twice leaves the table as it is."""
        return self._load_files(self.new_files(folder), False)

    def refresh_files(self, folder: str) -> Loaded:
        """Load every file of the folder in place of all that was loaded before."""
        return self._load_files(self._files(folder), True)

    def _load_files(self, files: DataFrame, full_refresh: bool) -> Loaded:
        wanted = files.collect()  # one line a file, as the reader is given their names
        if not wanted:
            return Loaded(None, [], self.spark.createDataFrame([], LEDGER_SCHEMA))
        listed = self.spark.createDataFrame([f[:3] for f in wanted], "path string, size long, modified timestamp")
        return self.load(scan_staged(self.spark, [f["at"] for f in wanted], with_file=True), full_refresh, listed)

    def load(self, staged: DataFrame, full_refresh: bool = False, files: DataFrame | None = None) -> Loaded:
        """Gate and load staged rows; raises ``GateBlocked`` with nothing loaded when a check fails.

        The staged rows are read once. Duplicate groups are counted over the key
        columns of what was written.
        """
        load_id = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        source = F.col("source_file") if "source_file" in staged.columns else F.lit(None).cast("string")
        checked = Observation(f"load {load_id}")
        judged = staged.observe(checked, *[v.alias(f"c{n}") for n, v in quality.row_checks().items()])
        (
            judged.withColumn("reject_reason", rejection_reason(staged))
            .select(*LANDING_NAMES, source.alias("source_file"), "reject_reason", F.current_timestamp().alias("loaded_at"),
                    F.lit(load_id).alias("load_id"),
                    F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected").alias("outcome"))
            .write.mode("append").partitionBy("load_id", "outcome").parquet(f"{self.path.rstrip('/')}/rows")
        )
        rows = self._rows().filter(F.col("load_id") == load_id)
        values = {int(k[1:]): v for k, v in checked.get.items()}
        values[4] = quality.duplicate_groups(rows, quality.GRAIN).first()["value"]
        checks = quality.require_values(values)
        per_file = rows.groupBy(F.col("source_file").alias("path")).agg(
            F.count(F.lit(1)).alias("rows_parsed"), F.count_if(F.col("outcome") == "accepted").alias("rows_loaded"),
            F.count_if(F.col("outcome") == "rejected").alias("rows_rejected"))
        if files is None:
            lines = per_file.withColumns({"size": F.lit(None).cast("long"), "modified": F.lit(None).cast("timestamp")})
        else:
            # A file without a row is listed too, so it is not read again.
            lines = files.join(per_file, "path", "left").fillna(0, ["rows_parsed", "rows_loaded", "rows_rejected"])
        columns = [x.split()[0] for x in LEDGER_SCHEMA.split(", ")]
        lines = lines.withColumns({"load_id": F.lit(load_id), "full_refresh": F.lit(full_refresh)}).select(*columns)
        # One file, so the load counts as a whole or not at all.
        lines.coalesce(1).write.mode("append").parquet(f"{self.path.rstrip('/')}/ledger")
        return Loaded(load_id, checks, self.ledger().filter(F.col("load_id") == load_id))
