"""Run queries against their SQL: ``python -m checks.compare FOLDER [NAME ...]``."""

import sys
import time

import duckdb

from checks.catalog import ORACLES, QUERIES
from leadloom.session import get_spark

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_KINDS = {"HUGEINT": "bigint", "VARCHAR": "string", "INTEGER": "int"}


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark, con, folder, name):
    """None if query and SQL agree in columns, types and rows, else what differs."""
    df = QUERIES[name](spark, folder)
    got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None if got[1] else "no rows"
    answer = con.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    kinds = {d[0]: _KINDS.get(str(d[1]), str(d[1]).lower()) for d in answer.description}
    want = _sorted_rows(columns, answer.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    mine = dict(df.dtypes)
    if mine != kinds:
        return f"types { {c: (mine[c], kinds[c]) for c in mine if mine[c] != kinds[c]} }"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows / {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main(folder, *names):
    spark = get_spark("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(folder), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            diff = differences(spark, con, folder, name)
        except Exception as error:  # reported per query, the rest still runs
            diff = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {time.time() - start:6.2f}s {name} {diff or ''}", flush=True)
    print(f"{failed} failed")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
