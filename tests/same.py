"""Compares a query's rows with its SQL's, in any order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def text(v):
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(text, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else f"{v:.6g}"
    if type(v).__name__ == "Decimal":
        return str(int(v)) if v == int(v) else f"{float(v):.6g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(text(v) for v in row) for row in df.astype(object).itertuples(index=False))
