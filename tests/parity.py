"""Runs registered queries beside their SQL twins in DuckDB and reports differences.

    python tests/parity.py [sf] [name-prefix ...]
"""
import math
import sys
import threading
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

LIMIT = 100
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.10g}") + 0.0
    if hasattr(v, "asDict"):
        v = list(v)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(want_cols) != sorted(df.columns):
        return len(got), f"columns differ: {sorted(df.columns)} vs {sorted(want_cols)}"
    if len(got) != len(want):
        return len(got), f"row count {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return len(got), f"{len(bad)} of {len(got)} rows differ, e.g.\n   {sorted(df.columns)}\n   {bad[0][0]}\n   {bad[0][1]}"
    return len(got), None


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    fails = []
    for name, fn in entry.queries().items():
        if prefixes and not any(name == p or name.startswith(p + "_") for p in prefixes):
            continue
        t = time.time()
        guard = threading.Timer(LIMIT, lambda: (spark.sparkContext.cancelAllJobs(), con.interrupt()))
        guard.start()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                n, err = compare(df, con, oracles[name])
            else:
                n, err = len(df.collect()), None
        except Exception as exc:
            lines = str(exc).strip().splitlines()
            n, err = -1, "ERROR " + " | ".join(lines[:4])[:700]
            if "-v" in sys.argv:
                traceback.print_exc()
        guard.cancel()
        tag = "FAIL" if err else ("ok  " if name in oracles else "rows")
        print(f"{tag} {name:42s} {n:8d} rows {time.time() - t:6.1f}s", flush=True)
        if err:
            print("   ", err, flush=True)
            fails.append(name)
    print("failed:", fails)
    return 1 if fails else 0


if __name__ == "__main__":
    sys.exit(main())
