"""Runs a query's SQL in DuckDB over the parquet tables of a directory."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        p = f if os.path.isfile(f) else f"{f}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(df) -> list[tuple]:
    """Rows as sorted tuples of text, floats rounded, columns by name."""
    out = []
    cols = sorted(df.columns)
    for r in df[cols].itertuples(index=False):
        row = []
        for v in r:
            if v is None or (isinstance(v, float) and v != v) or str(v) in ("NaT", "<NA>"):
                row.append("")
            elif isinstance(v, float):
                row.append(str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 5) + 0.0))
            elif hasattr(v, "tolist") and not isinstance(v, str):
                row.append(str(v.tolist()))
            else:
                row.append(str(v))
        out.append(tuple(row))
    return sorted(out)
