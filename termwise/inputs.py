"""Enrollment-shaped inputs derived from the supplied tables.

The supplied tables hold no enrollment records, so they are derived: a customer
is a student, an order month is a term. The text below is plain SQL that reads
the same on Spark and on a checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LND_SQL = """
WITH o AS (
  SELECT o_custkey AS k, o_orderkey, year(o_orderdate) + 20 AS y,
         CASE WHEN month(o_orderdate) <= 5 THEN '10' WHEN month(o_orderdate) <= 7 THEN '50' ELSE '90' END AS tt,
         CASE WHEN o_custkey % 10 < 6 THEN 'U' WHEN o_custkey % 10 < 9 THEN 'G' ELSE 'D' END AS lvl
  FROM {orders}),
p AS (SELECT k, o_orderkey, y, CAST(y AS STRING) || tt AS term_code,
             CASE WHEN k % 7 = 0 AND y >= 2019 AND lvl = 'U' THEN 'D' ELSE lvl END AS u_g FROM o),
d AS (SELECT k, u_g, y, term_code, min(o_orderkey) AS ok FROM p GROUP BY k, u_g, y, term_code),
b AS (SELECT *, min(term_code) OVER (PARTITION BY k, u_g) AS ft, max(term_code) OVER (PARTITION BY k, u_g) AS lt FROM d)
SELECT 'STU' || lpad(CAST(k AS STRING), 7, '0') AS student_id, u_g,
  CASE WHEN (k % 17) % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  CASE (k % 13 + CASE WHEN k % 9 = 0 AND y >= 2018 THEN 1 ELSE 0 END) % 5
    WHEN 0 THEN 'AD' WHEN 1 THEN 'CC' WHEN 2 THEN 'EN' WHEN 3 THEN 'SL' ELSE 'SM' END AS school,
  CASE u_g WHEN 'U' THEN CASE k % 4 WHEN 0 THEN 'BA' WHEN 1 THEN 'BAR' ELSE 'BS' END
           WHEN 'G' THEN CASE k % 3 WHEN 0 THEN 'MBA' ELSE 'MS' END ELSE 'PHD' END AS degtype,
  CASE WHEN k % 19 < 4 THEN '' WHEN k % 19 < 10 THEN 'Y' ELSE 'N' END AS firstgen,
  CASE WHEN (k + CASE WHEN k % 6 = 0 THEN y ELSE 0 END) % 11 < 2 THEN ''
       WHEN (k + CASE WHEN k % 6 = 0 THEN y ELSE 0 END) % 11 < 6 THEN 'Y' ELSE 'N' END AS pell,
  CAST(k % 30 AS STRING) AS ethnicmultirace, CAST(k % 5 AS STRING) AS citizen,
  CAST(3 + ok % 16 AS STRING) AS creditenr, CAST(y AS STRING) AS year_field,
  CASE substr(term_code, 5, 2) WHEN '10' THEN 'Spring' WHEN '50' THEN 'Summer' ELSE 'Fall' END AS semester,
  CASE WHEN term_code = lt AND k % 3 = 0 THEN 'Graduated'
       WHEN ok % 11 = 0 THEN 'Maintaining Registration' ELSE 'Enrolled' END AS academic_state,
  CASE WHEN term_code = ft THEN CASE WHEN k % 8 = 0 THEN '2' ELSE '1' END WHEN ok % 9 = 0 THEN '3' ELSE '4' END AS regstat,
  CAST(2 + ok % 3 AS STRING) || '.' || lpad(CAST(ok % 100 AS STRING), 2, '0') AS accumgpa, term_code
FROM b
"""

# Rows the derived table lacks: a graduate who comes back, and NULL dimensions.
EDGE_SQL = """
SELECT student_id, 'U' AS u_g, gender, school, 'XX' AS degtype, 'Y' AS firstgen, 'Y' AS pell,
  CAST(NULL AS STRING) AS ethnicmultirace, CAST(NULL AS STRING) AS citizen, CAST(NULL AS STRING) AS creditenr,
  CAST(NULL AS STRING) AS year_field, CAST(NULL AS STRING) AS semester, academic_state, regstat,
  CAST(NULL AS STRING) AS accumgpa, term_code
FROM (VALUES
  ('ZA', 'Female', 'EN', 'Graduated', '1', '201910'), ('ZA', 'Female', 'EN', 'Enrolled', '4', '201990'),
  ('ZB', 'Female', 'EN', 'Enrolled', '1', '201910'), ('ZB', 'Female', 'EN', 'Enrolled', '4', '201990'),
  ('ZC', 'Female', NULL, 'Enrolled', '1', '201910'), ('ZC', 'Female', 'EN', 'Enrolled', '4', '201990'),
  ('ZD', NULL, 'EN', 'Enrolled', '1', '201910'), ('ZD', NULL, 'EN', 'Graduated', '4', '201950')
) AS t(student_id, gender, school, academic_state, regstat, term_code)
"""

# The same records with defects, for the quality gate.
STAGED_SQL = """
WITH s AS (SELECT *, CAST(substr(student_id, 4) AS INT) AS k FROM {lnd}),
u AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE k % 113 = 0)
SELECT student_id, CASE WHEN k % 97 = 0 THEN 'X' ELSE u_g END AS u_g, gender,
  CASE WHEN k % 89 = 0 THEN NULL WHEN k % 83 = 0 THEN 'ZZ' ELSE school END AS school, degtype, firstgen,
  CASE WHEN k % 79 = 0 THEN 'X' ELSE pell END AS pell, ethnicmultirace, citizen, creditenr, year_field, semester,
  CASE WHEN k % 71 = 0 THEN 'Withdrawn' ELSE academic_state END AS academic_state,
  CASE WHEN k % 73 = 0 THEN '9' ELSE regstat END AS regstat, accumgpa,
  CASE WHEN k % 101 = 0 THEN '2015AB' ELSE term_code END AS term_code
FROM u
"""

# Scored snapshot: one row per student at the latest term, numeric term code.
RISK_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY term_code DESC, u_g) AS rn,
                  CAST(substr(student_id, 4) AS INT) AS k FROM {lnd})
SELECT student_id, u_g, school, degtype, pell, gender, academic_state, regstat,
  CAST(term_code AS INT) AS term_code,
  CASE WHEN academic_state <> 'Graduated' THEN CAST((k * 37 + CAST(creditenr AS INT) * 11) % 1000 AS DOUBLE) / 1000 END AS dropout_probability,
  CASE WHEN academic_state = 'Graduated' THEN NULL
       WHEN (k * 37 + CAST(creditenr AS INT) * 11) % 1000 >= 500 THEN 'YES' ELSE 'NO' END AS risk_flag
FROM r WHERE rn = 1
"""

# What users wrote, and beside it sentences that the phrase rules tell apart.
QUESTIONS_SQL = """
WITH t(i, q) AS (VALUES
  (0, 'Tell me the graduation rate among 2020 entrants'), (1, 'Does the pdf define who counts as retained?'),
  (2, 'Which caveats are mentioned in the annex?'), (3, 'Please summarise what I sent you'),
  (4, 'Per the report, how is the graduation rate worked out?'), (5, 'and then?'),
  (6, 'Would you go into a little more detail on that one point?'), (7, 'please chart those numbers'),
  (8, 'Degrees completed last year, by school'), (9, 'Share of Pell students this year'),
  (10, 'How did retention move last semester?'), (11, 'Headcount for the current term, please'),
  (12, 'Attrition across the past 4 years'), (13, 'Were recent cohorts any better?'),
  (14, 'Of the 2017 entrants, who was still here in Spring 2021?'),
  (15, 'Draw me a graph of attrition per college'), (16, 'Where does the data lineage chart live?'),
  (17, 'What is the chart of cohorts supposed to mean?'), (18, 'Do you see any trend?'),
  (19, 'Give me headcount trends by semester'), (20, 'Set the past year against the past 2 years and the current semester'))
SELECT conv_id, turn, text AS question FROM {conversations} u WHERE role = 'user'
UNION ALL
SELECT c.conv_id, c.turn, t.q AS question
FROM {conversations} c JOIN t ON t.i = (c.conv_id * 5 + c.turn) % 21
WHERE c.role = 'user'
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lnd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LND_SQL, orders=table(spark, sf_dir, "orders"))


def lnd_with_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lnd(spark, sf_dir).unionByName(spark.sql(EDGE_SQL))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STAGED_SQL, lnd=lnd(spark, sf_dir))


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RISK_SQL, lnd=lnd(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(QUESTIONS_SQL, conversations=table(spark, sf_dir, "conversations"))
