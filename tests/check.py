"""Run registered queries against their SQL: python tests/check.py [sf] [name part ...]"""

import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    return v


def compare(spark, con, f, sql, sf_dir):
    """(rows, seconds, problem) of one query."""
    start = time.time()
    df = f(spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if sql is None:
        return len(rows), took, None
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return len(rows), took, f"columns {df.columns} / {cols}"
    order = sorted(cols)
    a = sorted([repr([cell(r[c]) for c in order]) for r in rows])
    at = [cols.index(c) for c in order]
    b = sorted([repr([cell(r[i]) for i in at]) for r in want])
    if a != b:
        left = [x for x in a if x not in set(b)][:2]
        right = [x for x in b if x not in set(a)][:2]
        return len(rows), took, f"{len(a)} / {len(b)} rows; spark {left} sql {right}"
    return len(rows), took, None


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as e
    from postwatch.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    path = f"/root/testdata/sf{sf}"
    con = connect(path)
    oracles = e.oracle_sql()
    for name, f in e.queries().items():
        if len(sys.argv) > 2 and not any(p in name for p in sys.argv[2:]):
            continue
        try:
            n, took, problem = compare(spark, con, f, oracles.get(name), path)
        except Exception as error:  # noqa: BLE001
            n, took, problem = -1, 0, f"{type(error).__name__}: {str(error)[:700]}"
        mark = "ok  " if problem is None else "FAIL"
        print(f"@@ {mark} {name} rows={n} {took:.1f}s {'' if name in oracles else '(no sql)'} "
              f"{(problem or '')[:900]}", flush=True)
