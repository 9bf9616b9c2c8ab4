"""Headline figures, growth windows, load profile, filter values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as LF
from ..schema import EXPECTED_COLUMNS, FILTER_VALUE_COLUMNS
from .reports import with_report_columns


def _distinct_counting_null_once(col: str):
    """``len(set(values))``: distinct values, with null counted as one more member."""
    return (F.count_distinct(F.col(col))
            + F.coalesce(F.max(F.when(F.col(col).isNull(), 1).otherwise(0)), F.lit(0)))


def kpis(sales: DataFrame) -> DataFrame:
    """A1: one row; empty input gives zeros.

    Distinct invoices and customers are exact (no sketch): the plan
    de-duplicates map-side per key before the shuffle.
    """
    cols = set(sales.columns)
    sales = with_report_columns(sales)

    def members(c: str):  # an absent column has no members, not one null
        return _distinct_counting_null_once(c) if c in cols else F.lit(0).cast("long")

    agg = sales.agg(
        F.coalesce(F.sum("total_price"), F.lit(0)).alias("_rev"),
        (F.count(F.lit(1)) if cols & {"total_price", "qty"} else F.lit(0).cast("long")).alias("_n"),
        members("invoice_no").alias("total_orders"),
        members("company").alias("total_customers"),
        F.coalesce(LF.exact_total("qty"), F.lit(0.0)).alias("total_units"),
    )
    rev = F.col("_rev").cast("double")
    return agg.select(
        rev.alias("total_revenue"),
        LF.guarded_ratio(rev, "_n").alias("avg_transaction"),
        F.col("total_orders"),
        LF.guarded_ratio(rev, "total_orders").alias("aov"),
        F.col("total_customers"),
        LF.guarded_ratio(rev, "total_customers").alias("revenue_per_customer"),
        F.col("total_units"),
        LF.guarded_ratio("total_units", "_n").alias("avg_basket_size"),
    ).withColumns({
        "total_revenue_label": LF.currency_label("total_revenue"),
        "total_orders_label": F.format_number("total_orders", 0),
        "aov_label": LF.currency_label("aov"),
        "total_customers_label": F.format_number("total_customers", 0),
        "total_units_label": F.format_number("total_units", 0),
        "revenue_per_customer_label": LF.currency_label("revenue_per_customer"),
    })


# (name, window length in days): current = [anchor - len, ...], previous = [anchor - 2 len, anchor - len)
GROWTH_WINDOWS = [("30_day", 30), ("90_day", 90), ("yoy", 365)]


def growth(sales: DataFrame) -> DataFrame:
    """A2: growth of the last 30/90/365 days over the window before.

    Anchored at the latest invoice timestamp of the (filtered) data, a scalar
    subquery over one column. The second read keeps the last two years only:
    with a ``year`` column the subquery also prunes the snapshot's year
    partitions. No rows when there is no dated line.
    """
    by_year = "year" in sales.columns
    sales = with_report_columns(sales)
    latest = sales.agg(F.max("invoice_date").alias("anchor"))
    since = latest.select(F.col("anchor") - F.expr(f"INTERVAL '{2 * GROWTH_WINDOWS[-1][1]}' DAY")).scalar()
    recent = sales.where(F.col("invoice_date") >= since)
    if by_year:
        recent = recent.where(F.col("year") >= F.year(since))
    x = recent.select("invoice_date", F.col("total_price").alias("amount"),
                      latest.select("anchor").scalar().alias("anchor"))
    t = F.unix_micros(F.col("invoice_date"))
    a = F.unix_micros(F.col("anchor"))
    day = LF.MICROS_PER_DAY
    aggs = []
    for name, n in GROWTH_WINDOWS:
        cur = (t >= a - n * day)
        prev = (t >= a - 2 * n * day) & (t < a - n * day)
        aggs.append(F.coalesce(F.sum(F.when(cur, F.col("amount"))), F.lit(0)).alias(f"_{name}_cur"))
        aggs.append(F.coalesce(F.sum(F.when(prev, F.col("amount"))), F.lit(0)).alias(f"_{name}_prev"))
    g = x.groupBy("anchor").agg(*aggs)
    return g.select(
        *[LF.growth_pct(F.col(f"_{name}_cur"), F.col(f"_{name}_prev")).alias(f"growth_{name}")
          for name, _ in GROWTH_WINDOWS],
        F.col("_30_day_cur").cast("double").alias("current_30_day"),
        F.col("_30_day_prev").cast("double").alias("previous_30_day"),
        F.col("anchor").alias("anchor_date"),
    ).withColumns({f"growth_{name}_label": LF.signed_pct_label(f"growth_{name}") for name, _ in GROWTH_WINDOWS})


def data_profile(sales: DataFrame) -> DataFrame:
    """Row and column counts, missing expected columns, completeness, date span.

    Completeness is ``1 - null cells / all cells`` over every column of the
    loaded table (source, derived and category columns), in one pass.
    """
    cols = sales.columns
    null_cells = reduce(lambda a, b: a + b,
                        [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)) for c in cols])
    missing = [c for c in EXPECTED_COLUMNS if c not in cols]
    has_date = "invoice_date" in cols
    agg = sales.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(null_cells, F.lit(0)).cast("long").alias("_nulls"),
        (F.min("invoice_date") if has_date else F.lit(None).cast("timestamp")).alias("_min"),
        (F.max("invoice_date") if has_date else F.lit(None).cast("timestamp")).alias("_max"),
    )
    cells = F.col("row_count") * F.lit(len(cols))
    return agg.select(
        F.col("row_count"),
        F.lit(len(cols)).cast("long").alias("column_count"),
        F.lit(", ".join(missing)).alias("missing_columns"),
        F.when(cells > 0, (F.lit(1.0) - F.col("_nulls") / cells) * 100.0).alias("completeness_pct"),
        F.date_format("_min", "yyyy-MM-dd").alias("min_date"),
        F.date_format("_max", "yyyy-MM-dd").alias("max_date"),
    )


def filter_values(sales: DataFrame) -> DataFrame:
    """Sorted distinct non-null values of each filter column, long form.

    One pass: the columns are stacked into (column, value) pairs and
    de-duplicated together (partial de-duplication happens map-side).
    """
    present = [c for c in FILTER_VALUE_COLUMNS if c in sales.columns]
    if not present:
        return sales.sparkSession.createDataFrame([], "filter_column string, value string")
    stack = "stack({n}, {args}) as (filter_column, value)".format(
        n=len(present),
        args=", ".join(f"'{c}', cast(`{c}` as string)" for c in present))
    return (sales.select(F.expr(stack))
            .where(F.col("value").isNotNull())
            .distinct()
            .orderBy("filter_column", "value"))

