"""Sources: the cleaned, category-enriched sales table and its raw variant."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..session import configure, scratch_dir
from .fixtures import product_codes, sales_lines, sales_lines_raw
from .load import clean_sales, join_category, prepare_lookup, product_categories, with_category

# The source keeps its product list for an hour; the prepared lookup is reused for that
# long within one application (0: never), and a changed list is not seen meanwhile.
LOOKUP_TTL_SECONDS = 3600
_LOOKUPS: dict[tuple[str, str], tuple[float, DataFrame | None]] = {}


def categories(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    return product_categories(product_codes(spark, sf_dir))


def stored_categories(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """``categories`` written down, for joins with many lines: the planner then knows its size (before, it
    would take the product list's and shuffle the lines) and it is made once, not in every join."""
    found = categories(spark, sf_dir)
    if found is None:
        return None
    path = scratch_dir(spark, "categories")
    found.write.mode("append").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The prepared category lookup for a data folder (reused for the TTL)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    for old in [k for k, (t, _) in _LOOKUPS.items() if time.monotonic() - t >= LOOKUP_TTL_SECONDS]:
        del _LOOKUPS[old]
    if key in _LOOKUPS:
        return _LOOKUPS[key][1]
    lookup = prepare_lookup(categories(spark, sf_dir))
    _LOOKUPS[key] = (time.monotonic(), lookup)
    return lookup


def forget_lookups() -> None:
    _LOOKUPS.clear()


def sales(spark: SparkSession, sf_dir: str, enrich: bool = True) -> DataFrame:
    """The analysis table for a data folder.

    A fresh snapshot (see ``storage``) is read when one exists for this
    folder; otherwise the table is built lazily from the source tables, and the
    lines of exports appended to the snapshot are added to it.
    """
    configure(spark)
    from .storage import fresh_snapshot, with_appended  # local import: storage imports this module
    snap = fresh_snapshot(spark, sf_dir)
    if snap is not None:
        return snap
    typed = clean_sales(sales_lines(spark, sf_dir))
    attach = (lambda df: join_category(df, category_lookup(spark, sf_dir))) if enrich else (lambda df: df)
    return with_appended(spark, sf_dir, attach(typed), attach)


def sales_from_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + P1/P2: the all-text export, coerced."""
    configure(spark)
    return clean_sales(sales_lines_raw(spark, sf_dir))
