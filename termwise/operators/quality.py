"""Checks run on the staged rows before anything is loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the checked columns may hold, and the checks' names.
LEVELS = ("U", "G", "D")
SCHOOLS = ("AD", "CC", "EN", "SL", "SM")
STAGED_PELL = ("Y", "N", "")
REGSTATS = ("1", "2", "3", "4")
ACADEMIC_STATES = ("Enrolled", "Graduated", "Maintaining Registration")
TERM_SUFFIXES = ("10", "50", "90", "95")
GRAIN = ["student_id", "u_g", "degtype", "term_code"]
CHECK_NAMES = (
    "staged file has rows",
    "no nulls in key columns",
    "term_code valid format",
    "no duplicate rows at (student_id, u_g, degtype, term_code) grain",
    "u_g in (U, G, D)",
    "school in (AD, CC, EN, SL, SM)",
    "pell in (Y, N, '') -- blank is a known data state, decoded to Unknown in STG",
    "regstat in (1, 2, 3, 4)",
    "academic_state in (Enrolled, Graduated, Maintaining Registration)",
)


class GateBlocked(RuntimeError):
    """A staged file failed its checks and must not be loaded; ``checks`` has all nine."""

    def __init__(self, message: str, checks: list[dict]):
        super().__init__(message)
        self.checks = checks


def check_status(value: Column, expect_zero: Column) -> Column:
    """PASS when zero is expected and found, or when rows are expected and found."""
    return F.when(F.when(expect_zero, value == 0).otherwise(value > 0), "PASS").otherwise("FAIL")


def _outside(column: str, allowed: tuple[str, ...]) -> Column:
    return F.count_if(~F.col(column).isin(*allowed))


def duplicate_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many value combinations occur more than once; NULLs compare equal."""
    return (
        df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).cast("bigint").alias("value"))
    )


def row_checks() -> dict[int, Column]:
    """The value of each check that counts rows, by its number: aggregates of one pass.

    As in plain SQL, a NULL is neither inside nor outside a list, so it passes.
    """
    term = F.col("term_code")
    missing = F.lit(False)
    for column in ("student_id", "u_g", "degtype", "school", "term_code"):
        missing = missing | F.col(column).isNull()
    bad_term = (
        (F.length(term) != 6)
        | ~F.right(term, F.lit(2)).isin(*TERM_SUFFIXES)
        | ~term.rlike("^[0-9]{6}$")
    )
    return {
        1: F.count(F.lit(1)),
        2: F.count_if(missing),
        3: F.count_if(bad_term),
        5: _outside("u_g", LEVELS),
        6: _outside("school", SCHOOLS),
        7: _outside("pell", STAGED_PELL),
        8: _outside("regstat", REGSTATS),
        9: _outside("academic_state", ACADEMIC_STATES),
    }


def _judged(counted: DataFrame) -> DataFrame:
    """(check_no, value) with the name and status of each check."""
    names = F.array(*[F.lit(name) for name in CHECK_NAMES])
    return counted.select(
        "check_no",
        F.element_at(names, F.col("check_no")).alias("name"),
        "value",
        check_status(F.col("value"), F.col("check_no") != 1).alias("status"),
    )


def qc_checks(staged: DataFrame) -> DataFrame:
    """The nine checks as (check_no, name, value, status): one pass plus the duplicate count."""
    values = row_checks()
    one_pass = staged.agg(*[v.cast("bigint").alias(f"c{n}") for n, v in values.items()])
    counted = one_pass.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("check_no"), F.col(f"c{n}").alias("value")) for n in values]))
    ).unionByName(duplicate_groups(staged, GRAIN).select(F.lit(4).alias("check_no"), "value"))
    return _judged(counted)


def qc_summary(checks: DataFrame) -> DataFrame:
    """One row: how many checks passed and failed, and whether the load may run."""
    failed = F.count_if(F.col("status") == "FAIL").cast("bigint")
    return checks.agg(
        F.count_if(F.col("status") == "PASS").cast("bigint").alias("passed"),
        failed.alias("failed"),
        F.count(F.lit(1)).alias("total"),
        F.when(failed > 0, "BLOCKED").otherwise("OK").alias("decision"),
    )


def require_values(values: dict[int, int]) -> list[dict]:
    """The checks of counted ``values``; raises ``GateBlocked`` naming every failed one."""
    checks = [{"check_no": n, "name": CHECK_NAMES[n - 1], "value": v,
               "status": "PASS" if (v > 0 if n == 1 else v == 0) else "FAIL"} for n, v in sorted(values.items())]
    failed = [f"{c['name']} (value={c['value']})" for c in checks if c["status"] == "FAIL"]
    if failed:
        raise GateBlocked(f"{len(checks) - len(failed)} passed / {len(failed)} failed: " + "; ".join(failed), checks)
    return checks


def require_pass(staged: DataFrame) -> list[dict]:
    """Run the gate on its own; raise ``GateBlocked`` naming every failed check."""
    return require_values({r["check_no"]: r["value"] for r in qc_checks(staged).collect()})
