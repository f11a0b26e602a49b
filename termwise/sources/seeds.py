"""Code-lookup tables, small and fixed, so always safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Code lists.
SCHOOLS = {
    "AD": "Hillier College of Architecture and Design (HCAD)",
    "CC": "Ying Wu College of Computing (YWCC)",
    "EN": "Newark College of Engineering (NCE)",
    "SL": "College of Science and Liberal Arts (CSLA)",
    "SM": "Martin Tuchman School of Management (MTSM)",
}
CITIZENSHIP = {
    1: "US Citizen",
    2: "International",
    3: "US Permanent Resident",
    4: "Information Not Available",
}
REGISTRATION = {
    1: "First-time",
    2: "Transfer",
    3: "Stop-out / Readmit",
    4: "Continuing",
}
ETHNICITY = {
    1: "Native American-Alaskan Native",
    2: "Aboriginal",
    3: "Central African (Congo, Kenya, Uganda, etc.)",
    4: "Southern African (Namibia, Madagascar, etc.)",
    5: "Northern African (Morocco, Algeria, etc.)",
    6: "African American/Black",
    7: "Caribbean (Haiti, Dominican Republic, etc.)",
    8: "Central American (Nicaragua, Guatemala, etc.)",
    9: "Cuban",
    10: "Latino",
    11: "Hispanic",
    12: "Mexican",
    13: "Puerto Rican",
    14: "South American (Brazil, Venezuela, Argentina, etc.)",
    15: "Central Asian (Afghanistan, Kazakhstan, etc.)",
    16: "Southeast Asian (Indonesia, Thailand, Vietnam, etc.)",
    17: "South Asian (India, Pakistan, Bangladesh, etc.)",
    18: "East Asian (China, Japan, Korea, Philippines, etc.)",
    19: "Pacific-Islander (Fiji, Tahiti, Hawaii, etc.)",
    20: "Asian American",
    21: "Iberian-European (Spanish-Portuguese)",
    22: "Eastern European (Ukraine, Poland, Albania, etc.)",
    23: "Indo-European (Turkey, Azerbaijan, etc.)",
    24: "European (Italy, Sweden, Germany, etc.)",
    25: "Middle Eastern (Israel, Jordan, Lebanon, etc.)",
    26: "White American",
    27: "Australian/New Zealander",
}


def _sql_text(value) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values_list(codes: dict) -> str:
    """``(code, text), …`` for a VALUES clause."""
    return ", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in codes.items())


def _seed(spark: SparkSession, codes: dict, code: str, text: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values_list(codes)} AS seed({code}, {text})")


def school_codes(spark: SparkSession) -> DataFrame:
    return _seed(spark, SCHOOLS, "school_code", "school_name")


def citizen_codes(spark: SparkSession) -> DataFrame:
    return _seed(spark, CITIZENSHIP, "citizen_code", "citizen_description")


def regstat_codes(spark: SparkSession) -> DataFrame:
    return _seed(spark, REGISTRATION, "regstat_code", "regstat_description")


def ethnicity_codes(spark: SparkSession) -> DataFrame:
    return _seed(spark, ETHNICITY, "ethnicity_code", "ethnicity_description")
