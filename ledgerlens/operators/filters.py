"""Composable sales filters.

``SalesFilter`` is the sidebar state: an inclusive calendar-date range and
five value lists. It compiles to ONE boolean ``Column`` so Catalyst sees a
single conjunction it can push to the Parquet scan. Value lists keep rows
whose value is null, and an empty list means "no filter", not "no rows".
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_date(d: dt.date | str | None) -> dt.date | None:
    if d is None or isinstance(d, dt.date):
        return d
    return dt.date.fromisoformat(d)


def keep_selected_or_null(col: str, values) -> Column:
    """Selected values or null."""
    return F.col(col).isin(list(values)) | F.col(col).isNull()


@dataclass(frozen=True)
class SalesFilter:
    date_start: dt.date | str | None = None
    date_end: dt.date | str | None = None
    types: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    item_types: tuple[str, ...] = ()
    furniture_groups: tuple[str, ...] = ()

    def predicates(self, columns: list[str]) -> list[Column]:
        preds: list[Column] = []
        start, end = _as_date(self.date_start), _as_date(self.date_end)
        if start is not None and end is not None:
            # compare the calendar date; a null date never matches.
            preds.append(F.to_date(F.col("invoice_date")).between(F.lit(start), F.lit(end)))
            if "year" in columns:
                # lets a snapshot partitioned by year prune whole directories
                preds.append(F.col("year").between(start.year, end.year))
        value_filters = [
            ("type", self.types), ("status", self.statuses),
            ("product_category", self.categories), ("item_type", self.item_types),
            ("furniture_group", self.furniture_groups),
        ]
        for col, values in value_filters:
            if not values:
                continue
            if col not in columns:
                # category and furniture group are optional columns (as in the source); a
                # filter on any other absent column must not silently let every row through
                if col in ("product_category", "furniture_group"):
                    continue
                raise ValueError(f"cannot filter on {col!r}: the sales table has no such column")
            preds.append(keep_selected_or_null(col, values))
        return preds

    def predicate(self, columns: list[str]) -> Column | None:
        preds = self.predicates(columns)
        return reduce(lambda a, b: a & b, preds) if preds else None

    def apply(self, df: DataFrame) -> DataFrame:
        """one ``filter`` with the conjunction of the active parts."""
        p = self.predicate(df.columns)
        return df if p is None else df.filter(p)


def has_colour(df: DataFrame) -> DataFrame:
    """colour present means not null and not the empty string (no column: no rows)."""
    for c in ("colour", "short_description"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.filter(F.col("colour").isNotNull() & (F.col("colour") != ""))
