"""Run registered queries and their SQL side by side: python tests/compare.py [sf] [key ...]."""

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(v) if not isinstance(v, str) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def same(spark_df, con, sql):
    """None when equal, else a short description of the difference."""
    got_cols = spark_df.columns
    got = rows_of(got_cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}", len(got)
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {missing}", len(got)
    return None, len(got)


def session(cores=8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sf = argv[0] if argv else "sf0.01"
    folder = f"/root/testdata/{sf}"
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = argv[1:] or list(queries)
    spark, con, bad = session(), connect(folder), 0
    for k in keys:
        start = time.time()
        try:
            df = queries[k](spark, folder)
            if k in oracles:
                diff, n = same(df, con, oracles[k])
            else:
                diff, n = None, len(df.collect())
            mark = "ok  " if diff is None else "DIFF"
            if k not in oracles:
                mark = "rows"
        except Exception as e:  # noqa: BLE001
            diff, n, mark = str(e)[:900], -1, "FAIL"
        bad += mark in ("DIFF", "FAIL")
        print(f"{mark} {k} rows={n} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} fine; without SQL: {[k for k in keys if k not in oracles]}")


if __name__ == "__main__":
    main(sys.argv[1:])
