"""Compare Spark results with the DuckDB oracle: python -m tests.oracle_check [names...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from millrace.plans import all_entries
from millrace.plans.bridge import TABLES
from millrace.session import build_session


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canon(rows):
    def cell(v):
        if v is None:
            return (0, "")
        if isinstance(v, float):
            return (1, "nan") if math.isnan(v) else (1, repr(v + 0.0 if v != 0 else 0.0))
        return (1, str(v))

    return sorted(tuple(cell(v) for v in r) for r in rows)


def compare(spark, con, entry, folder):
    """(rows, oracle rows, equal, first difference)."""
    df = entry.run(spark, folder)
    cols = [c for c, _ in entry.columns]
    got = canon(tuple(r[c] for c in cols) for r in df.collect())
    if entry.sql is None:
        return len(got), None, None, None
    want = canon(con.execute(entry.oracle()).fetchall())
    diff = None
    if got != want:
        a, b = set(got), set(want)
        only_a = [r for r in got if r not in b][:2]
        only_b = [r for r in want if r not in a][:2]
        diff = [[x[1] for x in r] for r in only_a], [[x[1] for x in r] for r in only_b]
    return len(got), len(want), got == want, diff


def main(names):
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.millrace.hotGroupRows": os.environ.get("HOT_ROWS", "2000000")})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    entries = all_entries()
    bad = 0
    for name in names or entries:
        for name in [n for n in entries if n == name or (name.endswith("*") and n.startswith(name[:-1]))]:
            t = time.time()
            try:
                n, m, ok, diff = compare(spark, con, entries[name], folder)
                flag = "rows-only" if ok is None else ("ok" if ok else "DIFF")
                print(f"{flag:9s} {name:40s} {n} {m} {time.time() - t:.1f}s", diff or "", flush=True)
                bad += flag == "DIFF"
            except Exception as exc:  # report and go on
                bad += 1
                print(f"ERROR     {name:40s} {time.time() - t:.1f}s {str(exc)[:900]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
