"""Results of DuckDB's SQL over a folder of Parquet tables, in a form to compare."""

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).iterdir()):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def normal(df: pd.DataFrame) -> Counter:
    def one(v):
        if v is None or v is pd.NaT or isinstance(v, float) and pd.isna(v) or v is pd.NA:
            return None
        return round(float(v), 6) if isinstance(v, float) else str(v)

    return Counter(tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
