"""Runs registered queries against their SQL: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES
from tidewatch.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def expected(folder: str, name: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    done = db.execute(ORACLES[name])
    names = [d[0] for d in done.description]
    return sorted(names), rows_of(names, done.fetchall())


def compare(spark, folder: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return None
    names, wanted = expected(folder, name)
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {names}"
    if got != wanted:
        only_got = [r for r in got if r not in set(wanted)][:2]
        only_wanted = [r for r in wanted if r not in set(got)][:2]
        return f"{len(got)} rows against {len(wanted)}\n   spark {only_got}\n   sql   {only_wanted}"
    return None


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session("local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"@@ {name:32} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"@@ {bad} of {len(names)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
