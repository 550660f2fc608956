"""Compare registered queries with their SQL: ``python tests/check.py [sf_dir] [name …]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(table, names) -> list[tuple]:
    """Rows with columns in the given order, sorted; works on Arrow tables."""
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns), key=repr)


def difference(spark_table, sql_table) -> str | None:
    """What differs between two Arrow tables, or None."""
    names = sorted(spark_table.column_names)
    if names != sorted(sql_table.column_names):
        return f"columns {names} != {sorted(sql_table.column_names)}"
    if spark_table.num_rows != sql_table.num_rows:
        return f"rows {spark_table.num_rows} != {sql_table.num_rows}"
    left, right = rows_of(spark_table, names), rows_of(sql_table, names)
    for a, b in zip(left, right):
        if a != b:
            return f"{names}: {a!r:.600} != {b!r:.600}"
    kinds = [
        (n, str(spark_table.schema.field(n).type), str(sql_table.schema.field(n).type)) for n in names
    ]
    odd = [k for k in kinds if k[1] != k[2] and not (k[1].startswith("timestamp") and k[2].startswith("timestamp"))]
    return f"types {odd}" if odd else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, connection, oracles, bad = make_session(), connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            result = run(spark, sf_dir).toArrow()
            seconds = time.time() - start
            problem = None
            if name in oracles:
                problem = difference(result, connection.sql(oracles[name]).to_arrow_table())
            note = "ok" if problem is None else f"BAD {problem}"
            if name not in oracles:
                note += " (rows only)"
            print(f"{name:28s} {result.num_rows:8d} rows {seconds:6.2f} s  {note}", flush=True)
        except Exception as error:  # report and go on with the next query
            problem = str(error)
            print(f"{name:28s} FAILED {problem[:1200]}", flush=True)
        bad += problem is not None
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
