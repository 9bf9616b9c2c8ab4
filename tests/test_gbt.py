"""Boosted-tree forecasts: structure, bounds, repeatability (numbers differ from the source's library)."""

import pytest

from pyspark.sql import functions as F

from ledgerlens import sources
from ledgerlens.operators import forecast_gbt as FG
from ledgerlens.operators import forecast_linear as FL
from ledgerlens.operators import series as S

from conftest import SMALL


@pytest.fixture(scope="module")
def series(spark):
    return S.revenue_series(sources.sales(spark, SMALL)).checkpoint(eager=True)


def test_revenue_gbt_forecast(series):
    f = FG.revenue_forecast(series, 4).orderBy("horizon").collect()
    assert [r["horizon"] for r in f] == [1, 2, 3, 4]
    assert all(0 <= r["lower_ci"] <= r["forecast"] <= r["upper_ci"] for r in f)
    widths = [r["upper_ci"] - r["forecast"] for r in f]
    assert widths == sorted(widths)


def test_demand_gbt_forecast(spark):
    ds = S.demand_series(sources.sales(spark, SMALL), 3)
    f = FG.demand_forecast(ds, 3).collect()
    assert len(f) == 3 * ds.select("series_id").distinct().count()
    assert all(r["forecast"] >= 0 for r in f)


def forecast_rows(df):
    return [tuple(r) for r in df.orderBy("series_id", "horizon").collect()]


def test_demand_forecast_does_not_depend_on_top_n_or_partitions(spark):
    sales = sources.sales(spark, SMALL)
    every = S.demand_series(sales, None).checkpoint(eager=True)
    seen = []
    for parts, top_n in ((1, 2), (4, 5), (16, 5)):
        FG._MODELS.clear()  # a new fit, not the remembered one
        top = S.top_demand_products(sales, top_n)
        seen.append(forecast_rows(FG.demand_forecast(every.repartition(parts), 3, top)))
    assert seen[1] == seen[2] and len(seen[0]) == 6
    assert set(seen[0]) <= set(seen[1])


def test_revenue_fit_does_not_depend_on_partitions(series):
    seen = []
    for parts in (1, 16):
        FG._MODELS.clear()
        seen.append(forecast_rows(FG.revenue_forecast(series.repartition(parts), 3)))
    assert seen[0] == seen[1]


def test_boosted_trees_against_linear_on_a_seasonal_series(spark):
    """A seasonal series without trend (trees do not extrapolate one) and with noise."""
    import datetime as dt
    import math
    import random
    rnd = random.Random(3)
    rows = [("s", dt.datetime(2012 + i // 12, i % 12 + 1, 1), 1000 + 300 * math.sin(i * math.pi / 6) + rnd.gauss(0, 40))
            for i in range(108)]
    s = spark.createDataFrame(rows, "series_id string, month_start timestamp, y double").withColumn(
        "y_dec", F.col("y").cast(S.SERIES_DEC)).select("series_id", "month_start", "y_dec", "y")
    gbt, linear = FG.gbt_fit_metrics(s).first(), FL.revenue_fit_metrics(s).first()
    assert gbt["rmse"] <= 1.5 * max(linear["rmse"], 40), (gbt["rmse"], linear["rmse"])


def test_revenue_model_is_reused_within_ttl(spark, series):
    FG._MODELS.clear()
    m1 = FG._revenue_model(series)[0]
    m2 = FG._revenue_model(series)[0]
    rebuilt = S.revenue_series(sources.sales(spark, SMALL))  # same data, new plan
    m3 = FG._revenue_model(rebuilt)[0]
    assert m1 is m2 is m3
