"""Compare catalogue queries with their checking SQL: python tests/parity.py [sf_dir] [name…]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return repr(value)


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark, con, run, sql, sf_dir) -> str | None:
    """None when both sides hold the same rows, else a short account of what differs."""
    df = run(spark, sf_dir)
    left_names, left = _table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    right_names, right = _table([d[0] for d in cursor.description], cursor.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        return f"{len(left)} rows != {len(right)} rows\n   spark  {str(only_left)[:900]}\n   duckdb {str(only_right)[:900]}"
    return None if left else "EMPTY result on both sides"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from auditloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    session = local_session(8, 8)
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(sf)
    sql = oracle_sql()
    bad = 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                result = difference(session, connection, run, sql[name], sf)
            else:
                result = None if run(session, sf).count() else "EMPTY"
        except Exception as error:  # report and go on
            result = f"{type(error).__name__}: {str(error)[:700]}"
        bad += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print("failures:", bad)
