"""Compare registered queries with their oracle SQL: `python tests/oracle_check.py [sf] [names…]`."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("n", "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0))
    if isinstance(v, int):
        return ("n", repr(float(v)))
    if isinstance(v, (dt.date, dt.datetime)):
        return ("t", str(v))
    if v is None:
        return ("", "")
    if isinstance(v, (list, tuple)):
        return ("l", tuple(plain(x) for x in v))
    return ("s", str(v))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    got = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        extra = sorted(set(got[1]) - set(want[1]))[:2]
        return f"rows {len(got[1])} != {len(want[1])}; e.g. {extra}", len(got[1])
    if got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
        a, b = bad[0]
        cols = [(n, x, y) for n, x, y in zip(got[0], a, b, strict=True) if x != y]
        return f"{len(bad)} rows differ, first {str(cols)[:600]} in {str(a)[:200]}", len(got[1])
    return "", len(got[1])


def main(argv):
    from attestry.queries import ORACLES, QUERIES
    from attestry.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = argv[1:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    failed = []
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, sf_dir)
            if n in ORACLES:
                problem, rows = compare(df, con, ORACLES[n])
            else:
                problem, rows = "", df.count()
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem, rows = f"{type(exc).__name__}: {str(exc)[:900]}", -1
        tag = "FAIL" if problem else ("ok" if n in ORACLES else "rows")
        if not problem and rows == 0:
            tag = "EMPTY"
        print(f"{tag:5} {n:28} rows={rows:<8} {time.time() - t0:6.1f}s {problem}", flush=True)
        if tag in ("FAIL", "EMPTY"):
            failed.append(n)
    print(f"{len(names) - len(failed)}/{len(names)} pass; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
