"""Run registered queries beside their SQL checks: python tools/check.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import threading
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
from relievo.plans import load_all  # noqa: E402
from relievo.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    return df.sort_values(list(df.columns), kind="mergesort", na_position="first").reset_index(drop=True)


def difference(a: pd.DataFrame, b: pd.DataFrame) -> str | None:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} / {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    def kind(x):  # a nullable integer arrives as float64 from one engine and Int64 from the other
        return "nullable" if x.isna().any() and x.dtype.kind in "if" else str(x.dtype)

    kinds = {c: (kind(a[c]), kind(b[c])) for c in a.columns if kind(a[c]) != kind(b[c])}
    a, b = canonical(a), canonical(b)
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = np.flatnonzero(~same.to_numpy())
            return f"{len(i)} values of {c}, first {x.iloc[i[0]]!r} / {y.iloc[i[0]]!r}; types {kinds}"
    return f"types {kinds}" if kinds else None


LIMIT = float(os.environ.get("CHECK_LIMIT", "60"))


class Limit:
    """Calls `stop` when the block runs longer than the limit."""

    def __init__(self, stop):
        self.timer = threading.Timer(LIMIT, stop)

    def __enter__(self):
        self.timer.start()

    def __exit__(self, *_):
        self.timer.cancel()


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracles = load_all()
    names = args or list(queries)
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            with Limit(spark.sparkContext.cancelAllJobs):
                got = queries[n](spark, sf).toPandas()
        except Exception as e:
            bad += 1
            print(f"FAIL {n}: {type(e).__name__} {str(e)[:900]}", flush=True)
            continue
        t1 = time.time() - t
        if n not in oracles:
            print(f"rows {n}: {len(got)} rows, {t1:.1f}s", flush=True)
            continue
        try:
            with Limit(con.interrupt):
                want = con.execute(oracles[n]).df()
        except Exception as e:
            bad += 1
            print(f"FAIL {n}: SQL {str(e)[:900]}", flush=True)
            continue
        d = difference(got, want)
        bad += d is not None
        print(f"{'ok  ' if d is None else 'DIFF'} {n}: {len(got)} rows, {t1:.1f}s, sql {time.time() - t - t1:.1f}s"
              + (f" -- {d}" if d else ""), flush=True)
    print(f"{len(names) - bad}/{len(names)} good")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
