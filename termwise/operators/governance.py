"""Keep personal identifiers out of what is released."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIER_COLUMNS = ("student_id", "program_episode_id")
# Fixed value: the text shown instead of data.
REFUSAL = ("This query cannot be run — student identifiers cannot be returned "
           "in raw form per data privacy policy.")

# Outlines of identifiers that are listed; with more, every word is looked up.
OUTLINES = 1000
# Tasks that look words up: a fixed number, as rows this alike compress to a size that tells little of their memory.
LOOKUPS = 96


class ReleaseRefused(PermissionError):
    """Raised instead of releasing data; carries the reason and the columns."""

    def __init__(self, columns: list[str]):
        super().__init__(REFUSAL)
        self.reason = REFUSAL
        self.columns = columns


def mark_identifiers(df: DataFrame, columns=IDENTIFIER_COLUMNS) -> DataFrame:
    """Tag the identifier columns. The tag follows a column through projection,
    renaming, grouping keys, joins, unions and SQL; an aggregate drops it."""
    for name in columns:
        if name in df.columns:
            df = df.withMetadata(name, {"identifier": True})
    return df


def identifier_columns(df: DataFrame) -> list[str]:
    """Output columns that bear the tag, or have a field that does."""

    def tagged(field: T.StructField) -> bool:
        kind = field.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        return bool(field.metadata.get("identifier")) or isinstance(kind, T.StructType) and any(map(tagged, kind.fields))

    return [f.name for f in df.schema.fields if tagged(f)]


def release(df: DataFrame, identifiers: DataFrame | None = None) -> DataFrame:
    """Pass the frame on, or refuse if an identifier would be returned un-aggregated.

    Tags tell of columns handed on as they are. A value made from an identifier
    has lost its tag: with ``identifiers`` given, the values themselves are looked
    through as well, by a `leak_scan` job over the output.
    """
    exposed = identifier_columns(df)
    if not exposed and identifiers is not None:
        exposed = [r.column_name for r in leak_scan(df, identifiers).filter("leaked_rows > 0").collect()]
    if exposed:
        raise ReleaseRefused(exposed)
    return df


def release_strip(df: DataFrame) -> DataFrame:
    """Drop the tagged columns and keep the rest."""
    return df.drop(*identifier_columns(df))


def leak_scan(output: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Per column of ``output`` that can hold text, the rows in which a known identifier occurs.

    An identifier counts wherever it stands as a word, in any case: alone, in a
    sentence, as part of a hyphenated id, in an array, a struct or a map. Values
    are counted per column before the shuffle, so a value that fills a large
    share of the rows travels once. A frame without such columns has no rows.
    """
    texts = [f.name for f in output.schema.fields if _can_hold_text(f.dataType)]
    if not texts:
        return output.sparkSession.createDataFrame([], "column_name string, leaked_rows long")
    known = (identifiers.toDF("value").filter("value IS NOT NULL")
             .select(F.upper(F.col("value").cast("string")).alias("word")).distinct())
    cells = output.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col(f"`{name}`").cast("string").alias("value"))
        for name in texts])))
    counted = cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    value = F.upper("value")
    words = F.array_distinct(F.concat(
        F.array(value, F.trim(value)), F.regexp_extract_all(value, F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)),
        F.regexp_extract_all(value, F.lit("[\\p{L}\\p{N}_-]+"), F.lit(0))))
    # Words in no identifier's outline are left where they are: a word of every sentence would all go to one task.
    found = counted.select("column_name", "value", "n", F.explode(words).alias("word"))
    listed = known.select(_outline("word").alias("outline")).distinct().limit(OUTLINES + 1).agg(
        F.collect_set("outline").alias("outlines"))
    outlines = listed.select(F.when(F.size("outlines") <= OUTLINES, F.col("outlines"))).scalar()
    leaked = (found.filter(outlines.isNull() | F.array_contains(outlines, _outline("word")))
              .repartition(LOOKUPS, "word").join(known, "word", "left_semi").select("column_name", "value", "n").distinct()
              .groupBy("column_name").agg(F.sum("n").alias("leaked_rows")))
    # The output is worked out once: this reads the counted values' shuffle again.
    columns = counted.groupBy("column_name").agg(F.sum("n").alias("n")).filter("n > 0")
    return columns.join(leaked, "column_name", "left").select(
        "column_name", F.coalesce("leaked_rows", F.lit(0).cast("long")).alias("leaked_rows"))


def _outline(word: str):
    """A word with each ASCII digit as 0 and each letter from A to Z as A; equal words have equal outlines."""
    return F.translate(word, "123456789BCDEFGHIJKLMNOPQRSTUVWXYZ", "0" * 9 + "A" * 25)


def _can_hold_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _can_hold_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _can_hold_text(kind.keyType) or _can_hold_text(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_can_hold_text(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.StringType, T.BinaryType, T.VariantType))
