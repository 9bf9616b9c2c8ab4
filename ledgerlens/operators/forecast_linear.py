"""Seasonal-linear forecasts.

One ``groupBy(series_id)`` per fit, no driver loop: the same plan forecasts
one series or every product. Each series' months (bounded by the calendar)
are gathered in month order and the index, the line, the metrics and the
future months are array expressions on that one row. Sums are ordered
folds, so the numbers do not depend on partitioning.

Revenue (M5): seasonal index = month-of-year mean / mean of those means;
the series is deseasonalised, a least-squares line is fitted on the row
index, and the forecast is re-seasonalised and clipped at 0. The band
grows linearly with the horizon (M6). Demand (M9) fits the line on the raw
series and multiplies by the same kind of index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as LF
from .series import SERIES_DEC, ordered_sum

DEFAULT_HORIZON = 6

# Fixed values of the source's linear model.
Z_95 = 1.96
BAND_GROWTH_PER_STEP = 0.2
FALLBACK_STD_FACTOR = 0.15
TEST_POINTS = 3
MIN_POINTS_FOR_TEST = 6  # metrics on the last 3 points only when n > 6


def seasonal_index(series: DataFrame) -> DataFrame:
    """A22 / W6 (linear path): ``(series_id, moy, moy_mean, seasonal_index)``.

    Month-of-year mean (exact decimal sum / count) over the mean of those
    means; 1 when that mean is not positive. Same single grouped pass as the
    fit (``_moy_stats``).
    """
    g = _moy_stats(series)
    return g.selectExpr(
        "series_id", "inline(transform(_moy, r -> named_struct('moy', r.moy, "
        "'moy_mean', CAST(r.s AS DOUBLE) / r.c, 'seasonal_index', CASE WHEN _overall > 0 "
        "THEN (CAST(r.s AS DOUBLE) / r.c) / _overall ELSE 1D END)))")


# SQL fragments for the per-series fit. Higher-order functions are written as SQL
# text: one expression crosses to the JVM per column instead of one call per node.
_DEC0 = f"CAST(0 AS {SERIES_DEC})"


def _dsum_sql(arr: str, var: str, value: str) -> str:
    """Exact decimal sum of ``value`` over ``arr`` (a fold with a decimal zero)."""
    return f"aggregate({arr}, {_DEC0}, (acc, {var}) -> CAST(acc + {value} AS {SERIES_DEC}))"


def _fold_sql(arr: str, var: str, value: str) -> str:
    """Double sum of ``value`` added in array (month) order - the twin of ``ordered_sum``."""
    return f"aggregate({arr}, 0D, (acc, {var}) -> acc + {value})"


def _moy_stats(series: DataFrame) -> DataFrame:
    """One row per series: months in order (``_h``), per month-of-year exact sums and
    counts (``_moy``, months present only) and the mean of the month-of-year means."""
    g = series.groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct("month_start", "y_dec", "y"))).alias("_h"))
    in_moy = "filter(_h, e -> month(e.month_start) = m)"
    g = g.selectExpr(
        "series_id", "_h", "size(_h) AS _ni",
        "filter(transform(sequence(1, 12), m -> named_struct('moy', m, "
        f"'s', {_dsum_sql(in_moy, 'e', 'e.y_dec')}, 'c', size({in_moy}))), r -> r.c > 0) AS _moy")
    moy_mean = "(CAST(r.s AS DOUBLE) / r.c)"
    return g.selectExpr("*", f"{_fold_sql('_moy', 'r', moy_mean)} / size(_moy) AS _overall")


def _fit_series(series: DataFrame, deseasonalise: bool) -> DataFrame:
    """One row per series: seasonal index map, line, and in-sample metrics.

    A single ``groupBy(series_id)`` gathers the series' months (bounded by the
    calendar) in month order; the index, the least-squares line on the row
    index and the metrics are array expressions on that row, so the whole
    fit is one shuffle of the monthly table whatever the number of series.
    """
    g = _moy_stats(series)
    moy_mean = "(CAST(r.s AS DOUBLE) / r.c)"
    g = g.selectExpr(
        "*", "map_from_entries(transform(_moy, r -> struct(r.moy, "
             f"CASE WHEN _overall > 0 THEN {moy_mean} / _overall ELSE 1D END))) AS idx_map")
    g = g.selectExpr(
        "*", "transform(_h, (e, i) -> named_struct('x', CAST(i AS DOUBLE), 'y', e.y, "
             "'y_dec', e.y_dec, 'idx', element_at(idx_map, month(e.month_start)))) AS _pts")
    target = "(p.y / p.idx)" if deseasonalise else "p.y"
    g = g.selectExpr(
        "series_id", "idx_map", "_pts", "CAST(_ni AS DOUBLE) AS _n",
        "element_at(_h, -1).month_start AS _last_month",
        f"{_fold_sql('_pts', 'p', 'p.x')} AS _sx",
        f"{_fold_sql('_pts', 'p', target)} AS _sy",
        f"{_fold_sql('_pts', 'p', f'p.x * {target}')} AS _sxy",
        f"{_fold_sql('_pts', 'p', 'p.x * p.x')} AS _sxx",
        f"CAST({_dsum_sql('_pts', 'p', 'p.y_dec')} AS DOUBLE) / _ni AS _mean_y")
    g = g.selectExpr("*", "(_n * _sxy - _sx * _sy) / (_n * _sxx - _sx * _sx) AS slope")
    g = g.selectExpr("*", "(_sy - slope * _sx) / _n AS intercept")
    # residuals of the re-seasonalised line, and the last-3 test window
    is_test = f"(_n > {MIN_POINTS_FOR_TEST} AND p.x >= _n - {TEST_POINTS})"
    resid = "(p.y - (slope * p.x + intercept) * p.idx)"
    g = g.selectExpr(
        "*",
        f"{_fold_sql('_pts', 'p', f'CASE WHEN {is_test} THEN abs({resid}) ELSE 0D END')} AS _abs",
        f"{_fold_sql('_pts', 'p', f'CASE WHEN {is_test} THEN {resid} * {resid} ELSE 0D END')} AS _sq",
        f"CAST({_dsum_sql(f'filter(_pts, p -> {is_test})', 'p', 'p.y_dec')} AS DOUBLE) "
        f"/ {TEST_POINTS} AS _tmean",
        f"{_fold_sql('_pts', 'p', f'{resid} * {resid}')} AS _ss_res",
        f"{_fold_sql('_pts', 'p', '(p.y - _mean_y) * (p.y - _mean_y)')} AS _ss_tot")
    tdev = "(p.y - _tmean)"
    g = g.selectExpr(
        "*", f"{_fold_sql('_pts', 'p', f'CASE WHEN {is_test} THEN {tdev} * {tdev} ELSE 0D END')} AS _tss")
    has_test = F.col("_n") > MIN_POINTS_FOR_TEST
    return g.select(
        "series_id", "idx_map", "_n", "_last_month", "slope", "intercept",
        F.when(has_test, F.col("_abs") / TEST_POINTS).otherwise(0.0).alias("mae"),
        F.when(has_test, F.sqrt(F.col("_sq") / TEST_POINTS)).otherwise(0.0).alias("rmse"),
        F.when(F.col("_ss_tot") > 0, 1.0 - F.col("_ss_res") / F.col("_ss_tot"))
         .otherwise(0.0).alias("r2_train"),
        F.when(has_test & (F.col("_tss") > 0), 1.0 - F.col("_sq") / F.col("_tss"))
         .otherwise(0.0).alias("r2_test"),
        F.sqrt(F.col("_ss_tot") / F.col("_n")).alias("_pop_std"),
    )


def _future(fit: DataFrame, horizon: int) -> DataFrame:
    """P15 + J2: ``horizon`` month starts after the last month, index from the map (default 1)."""
    f = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon"))
    f = f.withColumn("month_start",
                     F.add_months(F.to_date("_last_month"), F.col("horizon")).cast("timestamp"))
    fidx = F.coalesce(F.element_at(F.col("idx_map"), F.month("month_start")), F.lit(1.0))
    trend = F.col("slope") * (F.col("_n") - 1.0 + F.col("horizon")) + F.col("intercept")
    return f.withColumn("forecast", LF.clip0(trend * fidx))


def revenue_fit_metrics(series: DataFrame) -> DataFrame:
    """A25 (linear path): MAE, RMSE and R² on the last 3 points (in-sample), R² on all."""
    fit = _fit_series(series, deseasonalise=True)
    return fit.select("series_id", F.lit("Seasonal Linear Regression").alias("model_type"),
                      "mae", "rmse", "r2_train", "r2_test")


def revenue_forecast(series: DataFrame, horizon: int = DEFAULT_HORIZON) -> DataFrame:
    """M5 + M6: forecast with a band ``± 1.96·σ·0.2·i`` (σ = RMSE, else 0.15·pop-std)."""
    f = _future(_fit_series(series, deseasonalise=True), horizon)
    se = F.when(F.col("rmse") > 0, F.col("rmse")).otherwise(F.col("_pop_std") * FALLBACK_STD_FACTOR)
    half = Z_95 * se * F.col("horizon").cast("double") * BAND_GROWTH_PER_STEP
    return f.select(
        "series_id", "month_start", "horizon", "forecast",
        LF.clip0(F.col("forecast") - half).alias("lower_ci"),
        (F.col("forecast") + half).alias("upper_ci"),
    )


def demand_forecast(series: DataFrame, horizon: int = DEFAULT_HORIZON) -> DataFrame:
    """M9: per product, line on the raw monthly units times the month-of-year index."""
    f = _future(_fit_series(series, deseasonalise=False), horizon)
    return f.select("series_id", "month_start", "horizon", "forecast")


# The source reports this pair for its seasonal-linear model.
LINEAR_IMPORTANCE = [("trend", 0.5), ("seasonality", 0.5)]


def linear_feature_importance(series: DataFrame) -> DataFrame:
    """K5 (linear path): the constant trend/seasonality pair, for each series that was fitted."""
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(v).alias("importance"))
                      for k, v in LINEAR_IMPORTANCE])
    fitted = series.select("series_id").distinct()
    return fitted.select("series_id", F.inline(pairs)).select(
        "series_id", "feature", "importance",
        LF.title_label("feature").alias("feature_label"),
        LF.pct_label("importance").alias("importance_label"))


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Total and monthly average of the forecast per series."""
    g = forecast.groupBy("series_id").agg(
        ordered_sum(F.col("forecast"), F.col("horizon")).alias("total_forecast"),
        F.count(F.lit(1)).alias("months"))
    return g.select("series_id", "total_forecast",
                    (F.col("total_forecast") / F.col("months")).alias("avg_monthly"), "months")


def forecast_table(forecast: DataFrame) -> DataFrame:
    """Month label, predicted value and range labels (``£#,##0``)."""
    return forecast.select(
        "series_id", "month_start",
        LF.long_month_label("month_start").alias("month"),
        LF.currency_label("forecast").alias("predicted_revenue"),
        F.concat(LF.currency_label("lower_ci"), F.lit(" - "),
                 LF.currency_label("upper_ci")).alias("confidence_range"),
    )


def demand_summary(series: DataFrame, forecast: DataFrame, model_type: str) -> DataFrame:
    """Historical monthly mean, forecast monthly mean and expected change per product."""
    hist = series.groupBy("series_id").agg(
        (F.sum("y_dec").cast("double") / F.count(F.lit(1))).alias("hist_avg"))
    tot = forecast_totals(forecast)
    j = hist.join(tot, "series_id")
    change = F.when(F.col("hist_avg") > 0,
                    (F.col("avg_monthly") / F.col("hist_avg") - 1.0) * 100.0).otherwise(F.lit(0.0))
    j = j.withColumn("expected_change_pct", change)
    return j.select(
        F.col("series_id").alias("product"),
        F.lit(model_type).alias("model"),
        "hist_avg",
        F.col("avg_monthly").alias("forecast_avg"),
        "expected_change_pct",
        "total_forecast",
        LF.plain_number(F.col("hist_avg"), 0).alias("hist_avg_label"),
        LF.plain_number(F.col("avg_monthly"), 0).alias("forecast_avg_label"),
        LF.signed_pct_label(F.col("expected_change_pct")).alias("expected_change_label"),
        LF.plain_number(F.col("total_forecast"), 0).alias("total_label"),
    )
