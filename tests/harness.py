"""Order-insensitive comparison of a Spark result with a DuckDB oracle."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float) or isinstance(v, np.floating):
        if math.isnan(v):
            return "NULL"
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (np.integer,)):
        return repr(int(v))
    if isinstance(v, bool) or isinstance(v, np.bool_):
        return repr(bool(v))
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().isoformat()
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if v is pd.NaT:
        return "NULL"
    return repr(v)


def rows_of(df) -> pd.DataFrame:
    """A Spark result as objects: integers stay integers beside nulls."""
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def canon_rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pd.notna(pdf[cols]), None) if len(pdf) else pdf[cols]
    return sorted(tuple(_canon(v) for v in row) for row in pdf.itertuples(index=False, name=None))


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> str | None:
    """None when equal, else a short description of the first differences."""
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(oracle_pdf.columns)}"
    if len(spark_pdf) != len(oracle_pdf):
        return f"row count {len(spark_pdf)} vs {len(oracle_pdf)}"
    a, b = canon_rows(spark_pdf), canon_rows(oracle_pdf)
    if a == b:
        return None
    sa, sb = set(a), set(b)
    only_a = sorted(sa - sb)[:3]
    only_b = sorted(sb - sa)[:3]
    return f"values differ; cols={sorted(spark_pdf.columns)}\n spark-only={only_a}\n oracle-only={only_b}"
