"""Compare a query with its SQL, run by DuckDB on the same files."""

from __future__ import annotations

import math

import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return ""
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return repr(v + 0.0) if v != int(v) else repr(int(v)) if abs(v) < 1e15 else repr(v)
        return str(v)

    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None))


def differences(got: pd.DataFrame, want: pd.DataFrame, show: int = 3) -> str:
    """Empty when equal as bags of rows."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if not bad:
        return ""
    cols = sorted(got.columns)
    pairs = [[(c, p, q) for c, p, q in zip(cols, x, y) if p != q][:4] for x, y in bad[:show]]
    return f"{len(bad)} of {len(a)} rows, e.g. {pairs}"
