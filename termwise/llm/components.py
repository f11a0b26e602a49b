"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwise.llm.texts import written


def _least(edges: DataFrame) -> DataFrame:
    """(a, b, m): each edge with the least of ``a`` and all that ``a`` has an edge to."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    return edges.join(least, F.col("a") == F.col("_a")).drop("_a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node reachable.

    Large and small stars in turn: every node hangs its greater neighbours, then
    its lesser ones, on the least it knows. Edges never grow in number beyond
    those given, and a few rounds flatten even long chains. Each round is
    written, so its lineage ends there. Null ends and loops count as no edge.
    """
    flat = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "edges")
    seen = None
    while True:
        mark = flat.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return flat.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                flat.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = tuple(mark)
        both = flat.unionByName(flat.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _least(large)
        flat = written(small.select("a", F.col("m").alias("b"))
                       .unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
                       .filter("a <> b").distinct(), "edges")
