"""Run registered queries against their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def normal(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    mine = normal(df.columns, df.collect())
    cursor = con.execute(sql)
    theirs = normal([c[0] for c in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        only_mine = [r for r in mine[1] if r not in set(theirs[1])][:3]
        only_theirs = [r for r in theirs[1] if r not in set(mine[1])][:3]
        return f"{len(mine[1])} rows / {len(theirs[1])} rows; only here {only_mine}; only there {only_theirs}"
    if not mine[1]:
        return "both empty"
    return None


def main(sf_dir: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from termwise.session import local_session

    spark, con = local_session(int(os.environ.get("BENCH_CPUS", 8))), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    print("without SQL:", sorted(set(queries) - set(sql)), "without query:", sorted(set(sql) - set(queries)))
    bad = 0
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                found = compare(spark, con, name, query, sql[name], sf_dir)
            else:
                found = None if query(spark, sf_dir).count() else "empty"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
