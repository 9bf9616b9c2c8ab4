"""The band's width when a model fits its last months without error (A28), and percentage labels."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlens import functions as LF
from ledgerlens.operators import forecast_linear as FL
from ledgerlens.operators import series as S


def sales(spark, amounts):
    """One line a month from January 2018 on."""
    rows = [(i, a) for i, a in enumerate(amounts)]
    return spark.createDataFrame(rows, "i int, amount double").select(
        F.add_months(F.lit("2018-01-15").cast("date"), F.col("i")).cast("timestamp").alias("invoice_date"),
        F.col("amount").cast("decimal(30,6)").alias("total_price"))


@pytest.mark.parametrize("amounts,spread", [([64.0, 192.0] * 18, 64.0), ([128.0] * 36, 0.0)])
def test_a_fit_without_error_takes_the_spread(spark, amounts, spread):
    """A pattern that repeats every year divides out exactly: no error, so the spread of the months."""
    series = S.revenue_series(sales(spark, amounts))
    metrics = FL.revenue_fit_metrics(series).first()
    assert metrics["rmse"] == 0.0
    for r in FL.revenue_forecast(series, 6).collect():
        half = 1.96 * 0.15 * spread * 0.2 * r["horizon"]
        want = amounts[(36 + r["horizon"] - 1) % 2]
        assert r["forecast"] == want
        assert math.isclose(r["upper_ci"], want + half) and math.isclose(r["lower_ci"], max(0.0, want - half))


def test_a_fit_with_error_takes_the_error(spark):
    amounts = [100.0 + (i * 37 % 11) for i in range(36)]
    series = S.revenue_series(sales(spark, amounts))
    rmse = FL.revenue_fit_metrics(series).first()["rmse"]
    assert rmse > 0
    for r in FL.revenue_forecast(series, 3).collect():
        assert math.isclose(r["upper_ci"] - r["forecast"], 1.96 * rmse * 0.2 * r["horizon"])


def test_percentage_labels(spark):
    df = spark.createDataFrame([(0.0,), (0.1234,), (0.9999,), (1.0,), (0.0004,)], "x double")
    assert [r[0] for r in df.select(LF.pct_label("x")).collect()] == [f"{100 * v:.1f}%" for v in (0.0, 0.1234, 0.9999, 1.0, 0.0004)]
