"""Compare a query with its SQL, as the driver does."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def normal(df: pd.DataFrame, digits: int = 6) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA:
            return None
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return tuple(cell(y) for y in list(x))
        if isinstance(x, dict):
            return tuple(sorted((k, cell(v)) for k, v in x.items()))
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, bool):
            return x
        try:
            if x != x:
                return None
            return round(float(x), digits) + 0.0
        except (TypeError, ValueError):
            return str(x)

    return sorted((tuple(cell(x) for x in row) for row in df.astype(object).itertuples(index=False, name=None)), key=repr)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    odd = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(odd)} rows differ, as {sorted(got.columns)}: {odd[:2]}" if odd else ""
