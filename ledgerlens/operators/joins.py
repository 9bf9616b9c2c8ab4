"""Join helpers: broadcast only what has a size bound by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def attach_scalar_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (anchor date, overall mean) to every row.

    ``one_row`` must be a global aggregate (no grouping keys), so its size is
    exactly one row; the broadcast is bounded by construction.
    """
    return df.crossJoin(F.broadcast(one_row))
