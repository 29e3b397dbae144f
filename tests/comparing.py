"""Query results against their SQL in DuckDB."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _shown(v):
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(str, v)) + "]"
    if v is None or v is pd.NA or v != v:
        return "NULL"
    return repr(round(float(v), 6)) if isinstance(v, (float, np.floating)) else str(v)


def rows(frame):
    return sorted(tuple(map(_shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()
