"""Run registered queries next to their SQL checks: ``python check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from hallwatch.plans.catalog import all_queries
from hallwatch.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("str"):
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or x != x else str(x))
        else:
            df[c] = df[c].astype("float64") if df[c].dtype != bool else df[c]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    got, want = rows(got), rows(want)
    for c in got.columns:
        a, b = got[c].astype(object).where(got[c].notna(), None), want[c].astype(object).where(want[c].notna(), None)
        bad = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
        if bad:
            return f"{len(bad)} values differ in {c}, first {a[bad[0]]!r} / {b[bad[0]]!r}"
    return "ok"


def main(folder: str, names: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'").fetchall()
    failed = 0
    for name, query in all_queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = query(spark, folder)
            got = df.toPandas()
        except Exception as error:  # report and go on with the next query
            print(f"{name}: SPARK {str(error)[:600]}", flush=True)
            failed += 1
            continue
        t1 = time.time()
        if query.check is None:
            print(f"{name}: {len(got)} rows, no SQL check ({t1 - t0:.1f}s)", flush=True)
            continue
        try:
            cur = con.execute(query.check)
            want = cur.fetchdf()
        except Exception as error:
            print(f"{name}: SQL {str(error)[:600]}", flush=True)
            failed += 1
            continue
        verdict = compare(got, want)
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        odd = [f"{c}:{kinds[c]}" for c in kinds if kinds[c] not in ("bigint", "double", "string", "boolean")]
        failed += verdict != "ok"
        print(f"{name}: {verdict} {len(got)} rows (spark {t1 - t0:.1f}s, sql {time.time() - t1:.1f}s) {' '.join(odd)}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]) > 0)
