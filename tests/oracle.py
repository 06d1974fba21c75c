"""Runs queries next to their SQL in DuckDB. From the shell: python tests/oracle.py SF_DIR [key ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else float(value) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


_KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
          "DATE": "date", "TIMESTAMP": "timestamp", "FLOAT": "float"}


def compare(df, con, sql) -> str | None:
    """None when names, types and values agree, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    kinds = {r[0]: _KINDS.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    got_kinds = dict(df.dtypes)
    wrong = {c: (got_kinds[c], kinds[c]) for c in names if got_kinds[c] != kinds[c]}
    got, want = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(names, expected)
    if len(got) != len(want):
        return f"{len(got)} rows <> {len(want)}; first {got[:2]} <> {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(want)} rows differ over {sorted(names)}, e.g. {bad[0]}"
    return f"types differ {wrong}" if wrong else None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf, keys = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for key in keys or queries:
        start = time.time()
        try:
            df = queries[key](spark, sf)
            problem = compare(df, con, oracles[key]) if key in oracles else None
            note = "" if key in oracles else f"(rows only: {df.count()})"
        except Exception as error:  # report and go on
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {key} {time.time() - start:.1f}s {note} {problem or ''}", flush=True)
    print(f"{failed} failed of {len(keys or queries)}, {len(oracles)} with SQL of {len(queries)}")


if __name__ == "__main__":
    main()
