"""Compares registered queries with their SQL in DuckDB: names, types, rows, values.

    python -m tests.oracle [query ...]       CHECK_SF_DIR chooses the tables
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def differences(df, con, sql: str) -> list[str]:
    """Empty when the DataFrame and the SQL give the same table."""
    problems = []
    result = con.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in result.description}
    sql_rows = result.fetchall()
    types = dict(df.dtypes)
    if sorted(types) != sorted(sql_types):
        return [f"columns {sorted(types)} vs {sorted(sql_types)}"]
    for name, dtype in types.items():
        if KINDS.get(dtype) != sql_types[name]:
            problems.append(f"type of {name}: {dtype} vs {sql_types[name]}")
    names = sorted(types)
    at = [list(sql_types).index(n) for n in names]
    rows = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    expected = sorted((tuple(r[i] for i in at) for r in sql_rows), key=_key)
    if len(rows) != len(expected):
        problems.append(f"{len(rows)} rows vs {len(expected)}")
    exact = 0
    for a, b in zip(rows, expected):
        exact += a == b
        if not all(_same(x, y) for x, y in zip(a, b)):
            problems.append(f"first difference:\n    {str(a)[:300]}\n    {str(b)[:300]}")
            break
    else:
        if exact != len(rows):
            problems.append(f"{len(rows) - exact} rows equal only within rounding")
    return problems


def main(names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = make_session(), connect(sf_dir)
    built, sqls, failed = queries(), oracle_sql(), 0
    for name in names or list(built):
        start = time.time()
        try:
            df = built[name](spark, sf_dir)
            if name in sqls:
                problems = differences(df, con, sqls[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as error:  # one broken query must not hide the others
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        mark = "ok  " if not problems else "FAIL"
        print(f"{mark} {time.time() - start:6.2f}s {name}", *problems, sep="\n     " if problems else " ")
    print(f"{failed} of {len(names or built)} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
