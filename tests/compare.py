"""Run queries next to their SQL on the same tables and compare the results.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(app: str = "hostweave-check", cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [
            "<null>" if v is None or (isinstance(v, float) and v != v) else
            ("true" if v else "false") if isinstance(v, bool) or type(v).__name__ == "bool_" else
            repr(float(v)) if isinstance(v, float) or type(v).__name__.startswith("float") else str(v)
            for v in df[c].tolist()
        ]
    return df.sort_values(list(df.columns), ignore_index=True) if len(df.columns) else df


def compare(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """None when both hold the same rows, else what differs."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} vs {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows vs {len(sql_rows)}"
    a, b = normal(spark_rows), normal(sql_rows)
    diff = (a != b).any(axis=1)
    if diff.any():
        cols = [c for c in a.columns if (a[c] != b[c]).any()]
        i = diff[diff].index[0]
        return f"{int(diff.sum())} of {len(a)} rows differ in {cols}: {a.loc[i, cols].to_dict()} vs {b.loc[i, cols].to_dict()}"
    return None


def rows_of(df) -> pd.DataFrame:
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)


def sql_rows(con, sql: str) -> pd.DataFrame:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return pd.DataFrame(cur.fetchall(), columns=names, dtype=object)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    names = args or list(queries)
    spark, con, bad = local_session(), duck(sf_dir), 0
    for name in names:
        t = time.time()
        try:
            got = rows_of(queries[name](spark, sf_dir))
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(e)[:600]}", flush=True)
            continue
        took = time.time() - t
        if name not in oracles:
            print(f"rows  {name}: {len(got)} rows, {took:.1f}s  {got.head(1).to_dict('records')}", flush=True)
            continue
        try:
            problem = compare(got, sql_rows(con, oracles[name]))
        except Exception as e:  # noqa: BLE001
            problem = f"SQL failed: {str(e)[:500]}"
        bad += problem is not None
        print(f"{'DIFF ' if problem else 'ok   '} {name}: {len(got)} rows, {took:.1f}s {problem or ''}", flush=True)
    print("problems:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
