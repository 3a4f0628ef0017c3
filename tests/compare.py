"""Runs registered queries next to their SQL and compares columns, types and rows."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pyarrow as pa


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    from standins.views import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(_plain(v) for v in r) for r in zip(*columns)), key=repr)


def types(table: pa.Table) -> dict[str, str]:
    def name(t: pa.DataType) -> str:
        if pa.types.is_large_string(t) or pa.types.is_string(t):
            return "string"
        return str(t)

    return {f.name: name(f.type) for f in sorted(table.schema, key=lambda f: f.name)}


def difference(df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    ours, theirs = df.toArrow(), con.sql(sql).to_arrow_table()
    if types(ours) != types(theirs):
        return f"types {types(ours)} vs {types(theirs)}"
    a, b = rows(ours), rows(theirs)
    if a == b:
        return None
    only_a, only_b = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
    return f"rows {len(a)} vs {len(b)}; ours {str(only_a)[:900]}; theirs {str(only_b)[:900]}"


def main(names: list[str], directory: str) -> None:
    import __spark_entry__ as entry
    from storygauge.session import build_session

    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(directory), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            result = "rows only: %d" % query(spark, directory).count() if name not in sqls else difference(query(spark, directory), con, sqls[name])
        except Exception as failure:  # noqa: BLE001
            result = f"{type(failure).__name__}: {str(failure)[:1500]}"
        status = "ok  " if result is None else "rows" if name not in sqls and result.startswith("rows only") else "DIFF"
        print(f"{status} {name} {time.time() - start:.2f}s {result or ''}", flush=True)


if __name__ == "__main__":
    main(sys.argv[2:], sys.argv[1])
