"""Compare registered queries with their DuckDB SQL: ``python tests/check_oracle.py [sf] [key ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as e  # noqa: E402
from retailflow.session import build_session  # noqa: E402


def canonical(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, key, folder):
    df = e.queries()[key](spark, folder)
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(e.oracle_sql()[key])
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    spark_types = dict(df.dtypes)
    same = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
            "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
    odd = {c: (types[c], spark_types[c]) for c in df.columns if same.get(types[c]) != spark_types[c]}
    a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"rows {len(a)} vs {len(b)}; first difference\n  {diff and diff[0]}\n  {diff and diff[1]}"
    if odd:
        return f"types {odd}"
    if not a:
        print(f"     {key}: no rows in either", flush=True)
    return None


def main(argv):
    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    keys = argv[1:] or list(e.queries())
    spark = build_session("check", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    bad = 0
    for key in keys:
        start = time.time()
        try:
            problem = compare(spark, con, key, folder) if key in e.oracle_sql() else "no oracle"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {key} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
