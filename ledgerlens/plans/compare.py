"""Compare a Spark result with a DuckDB oracle result (the correctness gate).

Columns are matched by name (sorted), rows are compared as a multiset of
tuples, floats exactly. Used by the test-suite and ``tools/check_oracle.py``.
"""

from __future__ import annotations

import math
from collections import Counter

from .. sources.fixtures import TABLES


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _norm(v):
    import datetime as dt
    import decimal

    import numpy as np
    import pandas as pd
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (np.floating,)):
        v = float(v)
        return None if math.isnan(v) else v
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, np.datetime64):
        return pd.Timestamp(v).to_pydatetime()
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        return dt.datetime(v.year, v.month, v.day)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    return v


def frame_rows(pdf) -> tuple[list[str], Counter]:
    cols = sorted(pdf.columns)
    rows = Counter()
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows[tuple(_norm(v) for v in rec)] += 1
    return cols, rows


def compare(spark_pdf, oracle_pdf, max_diff: int = 5) -> tuple[bool, str]:
    sc, sr = frame_rows(spark_pdf)
    oc, orows = frame_rows(oracle_pdf)
    if sc != oc:
        return False, f"columns differ: spark={sc} oracle={oc}"
    if len(spark_pdf) != len(oracle_pdf):
        return False, f"row count differs: spark={len(spark_pdf)} oracle={len(oracle_pdf)}"
    if sr == orows:
        return True, f"{len(spark_pdf)} rows equal"
    only_s = list((sr - orows).elements())[:max_diff]
    only_o = list((orows - sr).elements())[:max_diff]
    return False, f"values differ: spark-only={only_s} oracle-only={only_o}"
