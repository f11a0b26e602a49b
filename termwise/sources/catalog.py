"""Versioned rebuilds behind stable names in the session's catalog.

A rebuild writes each table under a name of its own and moves the stable names,
which are views, only after the last table stands. So a rebuild that fails half
way leaves every former table readable, and what it wrote goes. Replacing a view
is one step in the catalog; between two of them a reader may see tables of two
builds. Tables of former builds are dropped at the end, their files with them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from termwise.sources.layers import DEFAULT_LAYER, REPORT_VIEWS, STALE_VIEWS

_VERSION = re.compile("__v[0-9a-f]{12}$")


@dataclass
class CatalogStore:
    """Catalog tables under ``root``/LAYER, one database a layer, named ``prefix``_layer."""

    spark: SparkSession
    root: str
    prefix: str = "termwise"
    _version: str | None = field(default=None, init=False)
    _made: dict[tuple[str, str], str] = field(default_factory=dict, init=False)

    def database(self, layer: str | None = None) -> str:
        return f"{self.prefix}_{(layer or DEFAULT_LAYER).strip().lower()}"

    def path(self, name: str, layer: str | None = None) -> str:
        """A folder for data that is not rebuilt."""
        return f"{self.root.rstrip('/')}/{(layer or DEFAULT_LAYER).strip()}/{name}"

    def name(self, table: str, layer: str | None = None) -> str:
        return f"`{self.database(layer)}`.`{table}`"

    @contextmanager
    def rebuild(self) -> Iterator[CatalogStore]:
        """Tables replaced inside become visible together at the end, or not at all."""
        self._version, self._made = uuid.uuid4().hex[:12], {}
        try:
            yield self
        except BaseException:
            for table in self._made.values():
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self._version = None
            raise
        self._version = None
        for (layer, name), table in self._made.items():
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(name, layer)} AS SELECT * FROM {table}")
        self._drop_former()

    def replace(self, df: DataFrame, name: str, layer: str | None = None, spread_by: tuple[str, ...] = (),
                finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Write one table of the rebuild and return it as read back; ``finish`` as in `LayerStore.replace`."""
        if self._version is None:
            raise RuntimeError("replace belongs inside rebuild()")
        layer = (layer or DEFAULT_LAYER).strip()
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database(layer)}` LOCATION '{self.path('', layer)}tables'")
        table = self.name(f"{name}__v{self._version}", layer)
        self._made[layer, name] = table
        out = df.hint("rebalance", *spread_by) if spread_by else df
        out = finish(out) if finish else out
        writer = out.write.format("parquet")
        (writer.partitionBy(*spread_by) if spread_by else writer).saveAsTable(table)
        return self.spark.table(table).select(*out.columns)

    def read(self, name: str, layer: str | None = None) -> DataFrame:
        return self.spark.table(self.name(name, layer))

    def _drop_former(self) -> None:
        kept = set(self._made.values())
        for layer in {layer for layer, _ in self._made}:
            for row in self.spark.sql(f"SHOW TABLES IN `{self.database(layer)}`").collect():
                table = self.name(row.tableName, layer)
                former = _VERSION.sub("", row.tableName)
                if former != row.tableName and (layer, former) in self._made and table not in kept:
                    self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def create_report_views(self) -> list[str]:
        """The seven pass-through views, in the REPORT database; returns the names made."""
        for view, (layer, table) in REPORT_VIEWS.items():
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(view)} AS SELECT * FROM {self.name(table, layer)}")
        return list(REPORT_VIEWS)

    def drop_stale(self) -> None:
        """Drop what former releases called their objects, be it a view or a table."""
        present = {r.tableName for r in self.spark.sql(f"SHOW TABLES IN `{self.database()}`").collect()}
        views = {r.viewName for r in self.spark.sql(f"SHOW VIEWS IN `{self.database()}`").collect()}
        for name in STALE_VIEWS:
            if name in present:
                self.spark.sql(f"DROP {'VIEW' if name in views else 'TABLE'} IF EXISTS {self.name(name)}")
