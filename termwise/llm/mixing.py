"""Mixing sources to target weights by systematic sampling (DataFrame only).

Sources in code-point order, null last, weigh ``weights`` in turn and share
``share`` times all sizes; a target stops at ``most`` times its source's size
and the excess is shared again by weight. A document's expected copies are its
source's target over its source's size. Running sums of them within a source,
moved by one offset per source, emit a copy for each whole number crossed.

Documents of a source run in the order of size, then id, so that each stretch
of like sizes gives its share and the words taken come near the target. The
expected copies are the same for each document of a source, so a running sum is
a rank times a rate. Ranks are summed in levels (size, wide and narrow stretches
of ids): no task sorts a whole source, however large one source or size is.

Null source: a source of its own. Null id: first in its size. Null size: 0.
Equal rows: each counts. A source of size 0 has target 0 and gives no copies.
Documents of size 0 get copies like others of their source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termwise.llm.texts import WORD, packed, written

NARROW, WIDE = 256, 1 << 20
SEED = "mix"


def with_size(docs: DataFrame, name: str = "size") -> DataFrame:
    return docs.withColumn(name, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0,
                   seed: str = SEED) -> DataFrame:
    """(source, source_size, target, rate, shift) of each source in ``sizes``.

    Taken in the order of limit over weight, the fair level is the greatest of
    ``(rest of the total) / (rest of the weights)``: it rises while sources
    reach their limits and falls after the last that does.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("nth"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    key = F.concat(F.lit(f"{seed}|"), F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")))
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("nth", F.row_number().over(in_order))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") - 1) % len(weights) + 1)
                    .cast("double"))
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share))
                              - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                    / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("target", F.least("limit", F.max("level").over(whole) * F.col("weight")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("shift", F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("double") / 65536)
        .select("source", "source_size", "target", "rate", "shift")
    )


def ranks_before(cells: DataFrame, within: str, levels: list[str], count: str, out: str) -> DataFrame:
    """Rows before each cell of ``within``, cells ordered by ``levels``.

    Each level sums its cells' counts and runs over its siblings only.
    """
    result = cells
    for i, level in enumerate(levels):
        parent, own = [within, *levels[:i]], [within, *levels[:i + 1]]
        earlier = (Window.partitionBy(*parent).orderBy(F.col(level).asc_nulls_first())
                   .rowsBetween(Window.unboundedPreceding, -1))
        sums = (cells.groupBy(*own).agg(F.sum(count).alias("_n"))
                .withColumn(f"_before{i}", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
        sums = sums.select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(own)], f"_before{i}")
        on = [F.col(c).eqNullSafe(F.col(f"_k{j}")) for j, c in enumerate(own)]
        result = result.join(sums, on, "left").drop(*[f"_k{j}" for j in range(len(own))])
    total = sum((F.col(f"_before{i}") for i in range(len(levels))), F.lit(0))
    return result.withColumn(out, total).drop(*[f"_before{i}" for i in range(len(levels))])


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, source, size, ...) with source_size, target and copies.

    Columns of ``docs`` named source_size, target or copies are replaced; any others stay.
    """
    docs, unpack = packed(docs.drop("source_size", "target", "copies"), ["doc_id", "source", "size"])
    sources = written(
        source_targets(docs, weights, share, most, seed).withColumn("_nth", F.monotonically_increasing_id()), "sources")
    numbered = sources.select(F.col("source").alias("_source"), "_nth")
    placed = (
        docs.join(numbered, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        .withColumn("_wide", F.floor(F.col("doc_id") / WIDE))
        .withColumn("_narrow", F.floor(F.col("doc_id") / NARROW))
    )
    cell = ["_nth", "size", "_wide", "_narrow"]
    # Narrow rows: the cells are counted and kept, as every level reads them.
    cells = written(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows")), "cells")
    starts = (ranks_before(cells, cell[0], cell[1:], "_rows", "_start").drop("_rows")
              .select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(cell)], "_start"))
    on = [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(cell)]
    in_cell = Window.partitionBy(*cell).orderBy(F.col("doc_id").asc_nulls_first())
    before = F.col("_start") + F.row_number().over(in_cell) - 1
    facts = sources.select(F.col("_nth").alias("_fact"), "source_size", "target", "rate", "shift")
    crossed = (F.floor(F.col("shift") + (F.col("_k") + 1) * F.col("rate"))
               - F.floor(F.col("shift") + F.col("_k") * F.col("rate")))
    mixed = (
        placed.join(starts, on, "left")
        .withColumn("_k", before)
        .join(facts, F.col("_nth") == F.col("_fact"), "left")
        .withColumn("copies", crossed.cast("int"))
    )
    return unpack(mixed, "source_size", "target", "copies")


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy; documents without copies go."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
