"""Gate, load, rebuild every layer and test the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwise.operators.datatests import run_tests
from termwise.operators.governance import mark_identifiers
from termwise.plans import episodes as ep
from termwise.plans import facts, staging
from termwise.sources.catalog import CatalogStore
from termwise.sources.layers import AUDIT_COLUMNS, REPORT_VIEWS, LayerStore, create_report_views, drop_stale_views, with_audit
from termwise.sources.loads import LandingTable


@dataclass
class BuildResult:
    """What was built, its data tests, what the load did in all and per file, and the rows it left out with the reason."""

    tables: dict[str, DataFrame]
    tests: DataFrame
    report: DataFrame
    rejects: DataFrame
    files: DataFrame


def build_tables(landing: DataFrame, store: LayerStore | CatalogStore) -> dict[str, DataFrame]:
    """Rebuild the staged and report tables from landing, each written once.

    What depends on a table reads it back: a narrow columnar scan instead of the
    work behind it, and losing an executor never costs more than the stage at
    hand.
    """
    tables: dict[str, DataFrame] = {}

    def put(name: str, df: DataFrame, layer: str, spread_by: tuple[str, ...] = (),
            finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        stored = store.replace(df, name, layer, spread_by, lambda df: mark_identifiers(with_audit(finish(df))))
        tables[name] = mark_identifiers(stored.drop(*AUDIT_COLUMNS))
        return tables[name]

    # Spread by year, so that a question about some terms reads only those. Descriptions are added to the rows where
    # they are written: they are most of a row's bytes.
    stg = put("stg_student_enrollment", staging.typed_enrollment(landing), "STG", ("term_year",),
              staging.described_enrollment)
    calendar = put("stg_term_calendar", staging.stg_term_calendar(stg), "STG")
    # Gathered once, for the episodes and both term facts; not a table that the build hands out.
    entries = store.replace(mark_identifiers(ep.program_entries(stg)), "int_program_entries", "STG")
    episodes = put("int_program_episodes", ep.int_program_episodes(stg, calendar, entries), "STG")
    put("dim_program_episode", ep.dim_program_episode(episodes), "REPORT")
    put("fct_enrollment_term", facts.fct_enrollment_term(stg, episodes), "REPORT", ("term_year",))
    put("fct_graduation_rate", facts.fct_graduation_rate(episodes), "REPORT")
    put("fct_retention_rate_cohort", facts.fct_retention_rate_cohort(episodes), "REPORT")
    put("fct_graduation_rate_term", facts.fct_graduation_rate_term(stg, calendar, entries), "REPORT")
    put("fct_retention_rate_term", facts.fct_retention_rate_term(stg, calendar, entries), "REPORT")
    return tables


def rebuild(landing: DataFrame, store: CatalogStore) -> dict[str, DataFrame]:
    """`build_tables` as one versioned rebuild with its views; a failure leaves the former tables as they were."""
    with store.rebuild():
        build_tables(landing, store)
    store.drop_stale()
    store.create_report_views()
    return {table: mark_identifiers(store.read(view)) for view, (_, table) in REPORT_VIEWS.items()}


def build(staged: DataFrame, store: LayerStore, full_refresh: bool = True) -> BuildResult:
    """The daily batch: gate, load, rebuild, views, tests.

    Nothing is loaded unless every check passes. The staged rows are read once:
    what is written, checked and reported is the same pass. Rows that break a
    landing constraint stand beside the landing table, and the report, stored
    too, counts them.
    """
    landing = LandingTable(store.spark, store.path("student_enrollment", "LND"))
    loaded = landing.load(staged, full_refresh)
    total = loaded.report.agg(*(F.sum(x).alias(x) for x in ("rows_parsed", "rows_loaded", "rows_rejected")))
    report = store.replace(total.withColumn("table_rows", landing.read().agg(F.count(F.lit(1))).scalar()), "load_report", "LND")
    rejects = store.replace(landing.rejects(), "student_enrollment_rejects", "LND")
    tables = build_tables(landing.read(), store)
    drop_stale_views(store.spark)
    create_report_views(tables)
    return BuildResult(tables, run_tests(tables), report, rejects, loaded.report)
