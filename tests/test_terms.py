import pytest
from pyspark.sql import functions as F

from termwise.functions import scalars, terms


def _one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("term,year,season,after,before", [
    ("202490", 2024, "Fall", "202510", "202410"),
    ("202410", 2024, "Spring", "202490", "202390"),
    ("202450", 2024, "Summer", None, None),
    ("202495", 2024, "Winter", None, None),
    ("202477", 2024, None, None, None),
])
def test_decode(spark, term, year, season, after, before):
    assert _one(spark, terms.term_year("t"), t=term) == year
    assert _one(spark, terms.term_season("t"), t=term) == season
    assert _one(spark, terms.next_major_term("t"), t=term) == after
    assert _one(spark, terms.previous_major_term("t"), t=term) == before


def test_shift_round_trip(spark):
    assert _one(spark, terms.shift_year("t", 3), t="202490") == "202790"
    assert _one(spark, terms.shift_year("t", -3), t="202790") == "202490"
    assert _one(spark, terms.shift_year_number("CAST(t AS INT)", -2), t="202490") == 202290


def test_unknown_season_label(spark):
    assert _one(spark, terms.term_season("t", "Unknown"), t="202477") == "Unknown"


@pytest.mark.parametrize("text,number", [("3.6", 4), ("2.5", 3), ("-2.5", -3), (" 7 ", 7), ("x", None), ("", None),
                                         (None, None)])
def test_to_integer(spark, text, number):
    assert _one(spark, scalars.to_integer("t"), t=text) == number


@pytest.mark.parametrize("text,gpa", [("3.57", 3.57), ("123.4", None), ("abc", None)])
def test_to_gpa(spark, text, gpa):
    found = _one(spark, scalars.to_gpa("t"), t=text)
    assert (float(found) if found is not None else None) == gpa


@pytest.mark.parametrize("text,kept", [(None, "Unknown"), ("", "Unknown"), ("  ", "Unknown"), ("Y ", "Y ")])
def test_blank_to_unknown(spark, text, kept):
    assert _one(spark, scalars.blank_to_unknown("t"), t=text) == kept


@pytest.mark.parametrize("top,bottom,rate", [(2, 3, 66.6667), (1, 128, 0.7813), (1, 0, None), (-1, 3, -33.3333)])
def test_pct(spark, top, bottom, rate):
    assert spark.range(1).select(scalars.pct(str(top), str(bottom)).alias("v")).first()["v"] == rate


def test_joined_key_keeps_null(spark):
    assert _one(spark, scalars.joined_key("a", "b"), a="x", b=None) is None
    assert _one(spark, scalars.joined_key("a", "b"), a="x", b="y") == "x-y"


def test_term_start_date(spark):
    df = spark.createDataFrame([(2020, "Spring"), (2020, "Summer"), (2020, "Fall")], "y int, s string")
    got = [str(r[0]) for r in df.select(terms.term_start_date("y", "s = 'Spring'")).collect()]
    assert got == ["2020-01-01", "2020-09-01", "2020-09-01"]
    assert str(df.select(F.max(terms.cohort_start_date("y"))).first()[0]) == "2020-09-01"
