"""Monthly series and their window features.

A series is ``(series_id, month_start, y_dec, y)``: one row per month that
has lines (gaps are not filled, so lags count rows, not calendar months).
``y_dec`` is the exact decimal monthly sum; ``y`` is it as a double.

All window functions are ``partitionBy('series_id')``: a partition holds
one series' months, which is bounded by the calendar, never by the number
of lines. Rolling statistics are written as explicit lag arithmetic over a
fixed number of rows, and partition means divide an exact decimal sum by a
count, so a result does not depend on the order in which rows are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as LF
from .joins import attach_scalar_row

SERIES_DEC = "decimal(38,6)"
MAX_BROADCAST_PRODUCTS = 10_000

# Minimum history the source requires before it forecasts.
REVENUE_MIN_LINES = 12
REVENUE_MIN_MONTHS = 12
DEMAND_MIN_LINES = 30
DEMAND_MIN_MONTHS = 6
DEFAULT_TOP_N = 5


def _w(order: bool = True):
    w = Window.partitionBy("series_id")
    return w.orderBy("month_start") if order else w


def ordered_sum(value: Column, order: Column) -> Column:
    """Aggregate: sum of ``value`` added in ``order`` (a left fold from 0.0).

    For per-series statistics over a bounded number of months; the fixed
    order makes the double sum identical on every run and partitioning.
    """
    arr = F.array_sort(F.collect_list(F.struct(order.alias("k"), value.cast("double").alias("v"))))
    return F.aggregate(F.transform(arr, lambda e: e["v"]), F.lit(0.0), lambda a, b: a + b)


# --- building series --------------------------------------------------------

def revenue_series(sales: DataFrame, min_lines: int = REVENUE_MIN_LINES,
                   min_months: int = REVENUE_MIN_MONTHS) -> DataFrame:
    """Monthly revenue as one series ``'revenue'``; empty when history is too short."""
    dated = sales.where(F.col("invoice_date").isNotNull())
    m = (dated.groupBy(LF.month_start("invoice_date").alias("month_start"))
         .agg(F.sum("total_price").cast(SERIES_DEC).alias("y_dec"),
              F.count(F.lit(1)).alias("_lines"))
         .withColumn("series_id", F.lit("revenue")))
    return _gate(m, min_lines, min_months)


def _gate(m: DataFrame, min_lines: int, min_months: int) -> DataFrame:
    w = _w(order=False)
    m = (m.withColumn("_all_lines", F.sum("_lines").over(w))
         .withColumn("_months", F.count(F.lit(1)).over(w)))
    return (m.where((F.col("_all_lines") >= min_lines) & (F.col("_months") >= min_months))
            .select("series_id", "month_start", "y_dec", F.col("y_dec").cast("double").alias("y")))


def product_month_qty(sales: DataFrame) -> DataFrame:
    """Units per (product, month) over lines with product and date (one shuffle of lines)."""
    d = sales.where(F.col("short_description").isNotNull() & F.col("invoice_date").isNotNull())
    return (d.groupBy(F.col("short_description").alias("series_id"),
                      LF.month_start("invoice_date").alias("month_start"))
            .agg(F.sum(LF.exact_measure("qty")).cast(SERIES_DEC).alias("y_dec"),
                 F.count(F.lit(1)).alias("_lines")))


def top_demand_products(sales: DataFrame, top_n: int | None = DEFAULT_TOP_N,
                        min_lines: int = DEMAND_MIN_LINES,
                        pm: DataFrame | None = None) -> DataFrame:
    """A20 + K4: the ``top_n`` products by units (ties: product ascending).

    Empty when fewer than ``min_lines`` lines have product and date. With
    ``top_n=None`` every product is kept.
    """
    pm = product_month_qty(sales).checkpoint(eager=True) if pm is None else pm
    totals = pm.groupBy("series_id").agg(F.sum("y_dec").alias("_total"),
                                         F.sum("_lines").alias("_lines"))
    gate = totals.agg(F.sum("_lines").alias("_all_lines"))
    top = totals if top_n is None else (
        totals.orderBy(F.col("_total").desc(), F.col("series_id").asc()).limit(top_n))
    top = attach_scalar_row(top, gate).where(F.col("_all_lines") >= min_lines)
    return top.select(F.col("series_id").alias("product"),
                      F.col("_total").cast("double").alias("total_qty"))


def demand_series(sales: DataFrame, top_n: int | None = DEFAULT_TOP_N,
                  min_lines: int = DEMAND_MIN_LINES,
                  min_months: int = DEMAND_MIN_MONTHS) -> DataFrame:
    """J3 + A21: monthly units of the top products, one series per product.

    The top-N list has at most ``top_n`` rows, so up to ``MAX_BROADCAST_PRODUCTS`` it is
    broadcast into the semi-join; beyond that, or without a limit, the planner chooses.
    """
    # products x months: far smaller than the lines, and read three times below
    # (top-N totals, the line-count gate, the selected series), so it is
    # materialised once instead of re-aggregating the lines for each use
    pm = product_month_qty(sales).checkpoint(eager=True)
    top = top_demand_products(sales, top_n, min_lines, pm=pm).select(
        F.col("product").alias("series_id"))
    keep = F.broadcast(top) if top_n is not None and top_n <= MAX_BROADCAST_PRODUCTS else top
    s = pm.join(keep, "series_id", "left_semi")
    return _gate(s, 0, min_months)


# --- features -----------------------------------------------------------------

def _lag(k: int) -> Column:
    return F.lag("y", k).over(_w())


def _backfilled_lag(k: int) -> Column:
    """``shift(k)`` then back-fill, forward-fill, 0: the first value while n > k, else 0."""
    n = F.count(F.lit(1)).over(_w(order=False))
    first_y = F.min_by("y", "month_start").over(_w(order=False))
    return F.when(n > k, F.coalesce(_lag(k), first_y)).otherwise(F.lit(0.0))


def _rolling_mean(k: int) -> Column:
    """Mean of the last ``k`` rows including this one (fewer at the start)."""
    total = F.col("y")
    for i in range(1, k):
        total = total + F.coalesce(_lag(i), F.lit(0.0))
    return total / F.least(F.row_number().over(_w()), F.lit(k)).cast("double")


def _rolling_std3() -> Column:
    """Sample standard deviation of the last 3 rows; 0 with fewer than 2."""
    n = F.least(F.row_number().over(_w()), F.lit(3)).cast("double")
    m = _rolling_mean(3)
    dev = (F.col("y") - m) * (F.col("y") - m)
    for i in (1, 2):
        d = _lag(i) - m
        dev = dev + F.coalesce(d * d, F.lit(0.0))
    return F.when(n > 1, F.sqrt(dev / (n - 1))).otherwise(F.lit(0.0))


def _seasonal_index_features() -> Column:
    """Month-of-year mean over the series mean (1 when the series mean is not > 0)."""
    w_moy = Window.partitionBy("series_id", F.month("month_start"))
    w_all = _w(order=False)
    moy_mean = F.sum("y_dec").over(w_moy).cast("double") / F.count(F.lit(1)).over(w_moy)
    all_mean = F.sum("y_dec").over(w_all).cast("double") / F.count(F.lit(1)).over(w_all)
    return F.when(all_mean > 0, moy_mean / all_mean).otherwise(F.lit(1.0))


def month_features(series: DataFrame) -> DataFrame:
    """The revenue model's feature table.

    ``lag_12`` and ``yoy_growth`` are always present; a model uses them only
    when the series has more than 12 months.
    """
    lag12 = _lag(12)
    return series.select(
        "series_id", "month_start", "y",
        F.month("month_start").alias("month"),
        F.quarter("month_start").alias("quarter"),
        (F.row_number().over(_w()) - 1).alias("months_since_start"),
        _backfilled_lag(1).alias("lag_1"),
        _backfilled_lag(2).alias("lag_2"),
        _backfilled_lag(3).alias("lag_3"),
        _backfilled_lag(12).alias("lag_12"),
        _rolling_mean(3).alias("rolling_mean_3"),
        _rolling_mean(6).alias("rolling_mean_6"),
        _rolling_std3().alias("rolling_std_3"),
        F.when(lag12.isNotNull() & (lag12 != 0), F.col("y") / lag12 - 1.0)
         .otherwise(F.lit(0.0)).alias("yoy_growth"),
        _seasonal_index_features().alias("seasonal_index"),
    )


def demand_features(series: DataFrame) -> DataFrame:
    """M7: the demand model's features, per product."""
    return series.select(
        "series_id", "month_start", "y",
        F.month("month_start").alias("month"),
        (F.row_number().over(_w()) - 1).alias("months_since_start"),
        F.coalesce(_lag(1), F.min_by("y", "month_start").over(_w(order=False))).alias("lag_1"),
        _rolling_mean(3).alias("rolling_mean_3"),
        _seasonal_index_features().alias("seasonal_index"),
    )


def train_test_split(series: DataFrame) -> DataFrame:
    """First ``max(int(0.8 n), n - 6)`` rows train, the rest test."""
    n = F.count(F.lit(1)).over(_w(order=False))
    cut = F.greatest(F.floor(n * 0.8).cast("long"), n - 6)
    rn0 = F.row_number().over(_w()) - 1
    return series.select("series_id", "month_start", (rn0 < cut).alias("is_train"))


def trend_direction(series: DataFrame) -> DataFrame:
    """W8 + W9: slope sign of the last 6 points, and last vs 12th-from-last value.

    The slope's sign is taken from its exact numerator
    ``n*sum(x*y) - sum(x)*sum(y)`` in decimal (the denominator is positive).
    """
    rd = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("month_start").desc()))
    n_all = F.count(F.lit(1)).over(_w(order=False))
    s = series.select("series_id", "month_start", "y_dec", "y", rd.alias("_rd"), n_all.alias("_n"))
    last6 = F.col("_rd") <= 6
    x = (F.least(F.col("_n"), F.lit(6)) - F.col("_rd")).cast("decimal(10,0)")  # 0..k-1, oldest first
    g = s.groupBy("series_id").agg(
        F.count(F.when(last6, 1)).cast("decimal(10,0)").alias("_k"),
        F.sum(F.when(last6, x)).alias("_sx"),
        F.sum(F.when(last6, F.col("y_dec"))).alias("_sy"),
        F.sum(F.when(last6, x * F.col("y_dec"))).alias("_sxy"),
        F.max(F.when(F.col("_rd") == 1, F.col("y"))).alias("_last"),
        F.max(F.when(F.col("_rd") == 12, F.col("y"))).alias("_back12"),
        F.max(F.when(F.col("_rd") == F.col("_n"), F.col("y"))).alias("_first"),
        F.max("_n").alias("_n"),
    )
    num = F.col("_k") * F.col("_sxy") - F.col("_sx") * F.col("_sy")
    growth = F.when(
        F.col("_n") >= 12,
        F.when(F.col("_back12") > 0, (F.col("_last") / F.col("_back12") - 1.0) * 100.0)
         .otherwise(F.lit(0.0)),
    ).otherwise(
        F.when(F.col("_first") > 0,
               (F.pow(F.col("_last") / F.col("_first"), F.lit(12.0) / F.col("_n")) - 1.0) * 100.0)
         .otherwise(F.lit(0.0)))
    return g.select(
        "series_id",
        F.when(num > 0, F.lit("up")).otherwise(F.lit("down")).alias("trend_direction"),
        growth.alias("growth_vs_12th_last_pct"),
    )
