"""Compare every registered query with its SQL twin in DuckDB: ``python tests/check_oracle.py [sf_dir] [name …]``."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tallyfold.session import drop_scratch, local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(v)

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(df, con, sql):
    """Empty string when equal, else what differs."""
    have = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    if have != types:
        return f"types {have} != {types}"
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = canon([c[0] for c in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} rows differ, first {str(bad[0])[:400]}" if bad else ""


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con, twins, failed = local_session(8), connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in twins:
                problem = compare(run(spark, sf_dir), con, twins[name])
            else:
                problem = "" if run(spark, sf_dir).collect() else "no rows"
        except Exception as e:  # report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print("failed", failed)
    drop_scratch(spark)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
