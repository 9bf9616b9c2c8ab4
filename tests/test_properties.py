"""Properties that must hold on the real tables, whatever the partitioning."""

import pytest
from pyspark.sql import functions as F

from ledgerlens import sources
from ledgerlens.operators import forecast_linear as FL
from ledgerlens.operators import kpis as K
from ledgerlens.operators import reports as R
from ledgerlens.operators import series as S
from ledgerlens.plans.catalog import FILTERS

from conftest import SMALL


@pytest.fixture(scope="module")
def sales(spark):
    return sources.sales(spark, SMALL).cache()


def test_group_sums_plus_dropped_nulls_equal_total(sales):
    total = K.kpis(sales).first()["total_revenue"]
    by_type = sum(r["total_price"] for r in R.revenue_by_type(sales).collect())
    nulls = sales.where(F.col("type").isNull()).agg(F.sum("total_price")).first()[0]
    assert by_type + float(nulls or 0) == pytest.approx(total, abs=1e-6)


def test_filtered_is_subset(sales):
    for flt in FILTERS.values():
        sub = flt.apply(sales)
        assert sub.exceptAll(sales).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_results_do_not_depend_on_partitioning(sales, parts):
    base = FL.revenue_forecast(S.revenue_series(sales), 6).orderBy("horizon").collect()
    re = sales.repartition(parts)
    got = FL.revenue_forecast(S.revenue_series(re), 6).orderBy("horizon").collect()
    assert got == base
    assert R.colour_summary(re).collect() == R.colour_summary(sales).collect()


def test_forecast_bounds(sales):
    for r in FL.revenue_forecast(S.revenue_series(sales), 12).collect():
        assert 0 <= r["lower_ci"] <= r["forecast"] <= r["upper_ci"]
    for r in FL.demand_forecast(S.demand_series(sales, 10), 12).collect():
        assert r["forecast"] >= 0


def test_hot_customer_holding_a_third_of_lines(sales):
    """Skew: one customer gets a third of all lines; per-customer results stay exact."""
    hot = sales.withColumn("company", F.when(F.col("invoice_no") % 3 == 0, F.lit("HOT"))
                           .otherwise(F.col("company")))
    cv = R.customer_value(hot)
    kept = hot.where(F.col("company").isNotNull() & F.col("invoice_date").isNotNull())
    assert cv.agg(F.sum("total_revenue")).first()[0] == kept.agg(F.sum("total_price")).first()[0]
    want = kept.where(F.col("company") == "HOT").select("invoice_no").distinct().count()
    assert cv.where(F.col("customer") == "HOT").first()["order_count"] == want


def test_model_choice(sales):
    from ledgerlens.operators import forecast_gbt as FG
    s = S.revenue_series(sales)
    lin = FG.forecast_revenue(s, 3, method="linear").orderBy("horizon").collect()
    assert lin == FL.revenue_forecast(s, 3).orderBy("horizon").collect()
    with pytest.raises(ValueError):
        FG.forecast_revenue(s, 3, method="other")


def test_demand_model_choice(sales):
    from ledgerlens.operators import forecast_gbt as FG
    ds = S.demand_series(sales, 3).checkpoint(eager=True)
    lin = FG.forecast_demand(ds, 3, method="linear").orderBy("series_id", "horizon").collect()
    assert lin == FL.demand_forecast(ds, 3).orderBy("series_id", "horizon").collect()
    with pytest.raises(ValueError):
        FG.forecast_demand(ds, 3, method="other")
