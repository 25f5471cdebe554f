"""Run registered queries against their checking SQL.

Command line: ``python tests/compare.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import logging
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, str)):
        return value
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else ("f", value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], body


def compare(spark, con, query, sql, sf_dir):
    """Empty string when equal, else a description of the difference."""
    start = time.time()
    df = query(spark, sf_dir)
    spark_cols, spark_rows = table(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time() - start
    cur = con.execute(sql)
    duck_cols, duck_rows = table([d[0] for d in cur.description], cur.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} / {duck_cols}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} / {len(duck_rows)}: {spark_rows[:2]} / {duck_rows[:2]}"
    bad = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if bad:
        return f"{len(bad)} of {len(spark_rows)} rows differ in {spark_cols}, e.g.\n    {bad[0][0]}\n    {bad[0][1]}"
    return "" if spark_rows else "both empty"


TIMES = {}


def module_of(fn):
    return fn.__module__.rsplit(".", 1)[-1]


def main() -> None:
    from gridspark.plans import ORACLES, QUERIES
    from gridspark.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not sys.argv[2:] or any(n == a or module_of(QUERIES[n]) == a for a in sys.argv[2:])]
    logging.getLogger("DataFrameQueryContextLogger").disabled = True
    logging.disable(logging.CRITICAL)
    spark, con = local_session(8), connect(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                result = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
            else:
                rows = QUERIES[name](spark, sf_dir).collect()
                result = "" if rows else "no rows"
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:600]}"
        mark = "ok  " if not result else "FAIL"
        print(f"{mark} {TIMES.pop('spark', 0):6.2f}s of {time.time() - start:6.2f}s {name} {result}", flush=True)
        if result:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok", failed)


if __name__ == "__main__":
    main()
