"""The stored chunk table: replaced source by source, listed and counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termwise.operators import documents
from termwise.session import scratch_path

CHUNK_SCHEMA = "source string, chunk int, chunk_id string, text string"


@dataclass
class ChunkStore:
    """Chunks as Parquet in ``buckets`` folders by a hash of their source.

    A load rewrites only the folders of the sources it brings. Choose ``buckets``
    once, so that a folder is a few files; a folder that one source fills is
    split into files of even size. The rows of a folder are replaced together,
    so running a load again ends in the same table.
    """

    spark: SparkSession
    path: str
    buckets: int = 256

    def _bucket(self):
        return F.pmod(F.xxhash64("source"), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{CHUNK_SCHEMA}, bucket int").parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def load(self, chunks: DataFrame) -> None:
        """Replace every source in ``chunks``; a source without chunks there keeps its old ones."""
        spread = self.spark.createDataFrame([], f"{CHUNK_SCHEMA}, bucket int").write.partitionBy("bucket")
        spread.mode("ignore").parquet(self.path)
        # Cut once: the sources decide which folders are read, before the rows are written.
        staged = scratch_path(self.spark, "chunks")
        chunks.select("source", "chunk", "chunk_id", "text").withColumn("bucket", self._bucket()).write.parquet(staged)
        fresh = self.spark.read.parquet(staged)
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
        kept = self._stored().filter(F.col("bucket").isin(touched)).join(
            fresh.select("source").distinct(), "source", "left_anti")
        (
            kept.unionByName(fresh).hint("rebalance", "bucket").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        )

    def load_documents(self, docs: DataFrame) -> None:
        """Cut (source, text) and load the chunks."""
        self.load(documents.chunk_documents(docs))

    def sources(self) -> DataFrame:
        return documents.list_sources(self.read())

    def chunk_count(self) -> DataFrame:
        return self.read().agg(F.count(F.lit(1)).alias("n_chunks"))
