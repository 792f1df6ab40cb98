"""Compare a Spark result with the SQL twin on the same tables."""

import glob
import os

import duckdb
import pandas as pd


def run_sql(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con.sql(sql).df()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA else str(x))
    keys = [df[c].map(lambda x: (x is not None and x == x, str(x))) for c in df.columns]
    order = pd.concat(keys, axis=1).apply(tuple, axis=1).sort_values(kind="stable").index
    return df.loc[order].reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> list[str]:
    out = []
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"]
    if len(spark_df) != len(sql_df):
        return [f"rows {len(spark_df)} vs {len(sql_df)}"]
    a, b = canonical(spark_df), canonical(sql_df)
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            at = (~same).idxmax()
            out.append(f"{c}: {(~same).sum()} differ, e.g. {x[at]!r} vs {y[at]!r}"[:400])
        elif str(x.dtype).lower() != str(y.dtype).lower() and not x.isna().any():
            out.append(f"{c}: type {x.dtype} vs {y.dtype}")
    return out
