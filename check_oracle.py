"""Compare every registered query with its SQL on one scale.

    python check_oracle.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from wardline.plans.catalog import ORACLES, QUERIES
from wardline.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return "nan"
        return repr(round(float(value), 9) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return str(value)


def normalized(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(cell(row[i])) for i in order) for row in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return db


def compare(spark, db, name: str, sf_dir: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return f"rows-only {len(rows)}"
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    wanted = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}"
    left, right = normalized(df.columns, rows), normalized(columns, wanted)
    if left == right:
        return f"ok {len(rows)}"
    only_left = sorted(set(left) - set(right))[:2]
    only_right = sorted(set(right) - set(left))[:2]
    return f"DIFF spark {len(rows)} sql {len(wanted)}\n    spark only {only_left}\n    sql only   {only_right}"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args or any(n.startswith(p) for p in args)]
    spark = build_session(cpus=8, **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            result = compare(spark, db, name, sf_dir)
        except Exception as exc:  # report and go on with the next query
            result = "ERROR " + " ".join(str(exc).split())[:600]
        good = result.startswith(("ok", "rows-only"))
        bad += not good
        print(f"{name:36s} {time.time() - started:6.1f}s {result}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
