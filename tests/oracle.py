"""Compare registered queries with their SQL on DuckDB.  Usage: python -m tests.oracle [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(sf_dir) / name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark_rows, spark_columns, con, sql) -> str | None:
    """None when equal, else a short description of the difference."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    if sorted(columns) != sorted(spark_columns):
        return f"columns {sorted(spark_columns)} vs {sorted(columns)}"
    left, right = bag(spark_columns, spark_rows), bag(columns, rows)
    for one, other in zip(sorted(spark_columns), sorted(columns)):
        a = next((r[spark_columns.index(one)] for r in spark_rows if r[spark_columns.index(one)] is not None), None)
        b = next((r[columns.index(other)] for r in rows if r[columns.index(other)] is not None), None)
        if a is not None and b is not None and type(a) is not type(b):
            return f"type of {one}: {type(a).__name__} vs {type(b).__name__}"
    if left == right:
        return None
    return (f"rows {len(spark_rows)} vs {len(rows)}; only spark {list((left - right).items())[:3]}; "
            f"only sql {list((right - left).items())[:3]}")


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from wardenlake.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = oracle_sql()
    bad = 0
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in oracles:
                print(f"{took:6.2f}s ROWS {name} {len(rows)} {rows[:1] if wanted else ''}", flush=True)
                continue
            diff = compare(rows, df.columns, con, oracles[name])
        except Exception as error:  # report and go on with the next query
            took, diff, rows = time.time() - start, f"{type(error).__name__}: {str(error)[:700]}", []
        bad += diff is not None
        print(f"{took:6.2f}s {'OK  ' if diff is None else 'DIFF'} {name} {len(rows)} {diff or ''}"
              f"{rows[:2] if wanted and diff is None else ''}", flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
