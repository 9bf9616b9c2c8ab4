"""Hand-made edge rows (FIXTURES.md section 5)."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest

from ledgerlens.operators import forecast_linear as FL
from ledgerlens.operators import kpis as K
from ledgerlens.operators import reports as R
from ledgerlens.operators import series as S
from ledgerlens.operators.filters import SalesFilter
from ledgerlens.schema import SALES_SCHEMA
from ledgerlens.sources.load import clean_sales, product_categories, with_category

COLS = [f.name for f in SALES_SCHEMA.fields]


def ts(s):
    return dt.datetime.fromisoformat(s)


def make(spark, rows):
    base = {c: None for c in COLS}
    base.update(qty=1.0, price=Decimal("1"), discount=Decimal("0"), total_price=Decimal("1"),
                weight_kg=0.0)
    data = [tuple({**base, **r}[c] for c in COLS) for r in rows]
    return clean_sales(spark.createDataFrame(data, SALES_SCHEMA))


def monthly_rows(n_months, start="2020-01-01", per_month=1, amount="100", product=None):
    d0 = ts(start)
    out = []
    for i in range(n_months):
        y, m = d0.year + (d0.month - 1 + i) // 12, (d0.month - 1 + i) % 12 + 1
        for j in range(per_month):
            out.append(dict(invoice_no=i * 10 + j, invoice_date=dt.datetime(y, m, 5),
                            total_price=Decimal(amount) + i, qty=float(10 + i),
                            short_description=product))
    return out


def test_coercion_of_text(spark):
    raw = spark.createDataFrame(
        [("1", "2020-01-02", " 3 ", "x", "1e3"), ("2", "not a date", "1,000", None, "n/a")],
        "invoice_no string, invoice_date string, qty string, total_price string, weight_kg string")
    got = clean_sales(raw).orderBy("invoice_no").collect()
    assert got[0]["invoice_date"] == ts("2020-01-02") and got[0]["qty"] == 3.0
    assert got[0]["total_price"] == 0 and got[0]["weight_kg"] == 1000.0
    assert got[1]["invoice_date"] is None and got[1]["qty"] == 0.0 and got[1]["weight_kg"] == 0.0
    assert got[1]["year"] is None and got[1]["year_month"] is None


def test_display_headers_are_accepted(spark):
    raw = spark.createDataFrame([("7", "5")], "`Invoice No` string, `Total Price` string")
    assert clean_sales(raw).columns == ["invoice_no", "total_price"]


def test_value_filters_keep_nulls_and_empty_list_is_no_filter(spark):
    df = make(spark, [dict(type="A"), dict(type="B"), dict(type=None)])
    assert SalesFilter(types=("A",)).apply(df).count() == 2
    assert SalesFilter(types=()).apply(df).count() == 3


def test_date_filter_drops_null_dates_and_is_inclusive(spark):
    df = make(spark, [dict(invoice_date=ts("2020-01-01 23:59:00")),
                      dict(invoice_date=ts("2020-01-03")), dict(invoice_date=None)])
    assert SalesFilter(date_start="2020-01-01", date_end="2020-01-02").apply(df).count() == 1


def test_category_filter_ignored_without_lookup(spark):
    df = make(spark, [dict(type="A")])
    assert SalesFilter(categories=("Furniture",)).apply(df).count() == 1


def test_both_flags_means_furniture(spark):
    codes = spark.createDataFrame(
        [("chair", " l "), ("chair", "F"), ("lamp", "L"), ("x", "?"), (None, "F")],
        "Description string, `Landscape or Furniture` string")
    cats = {r["description"]: r["category"] for r in product_categories(codes).collect()}
    assert cats == {"chair": "Furniture", "lamp": "Landscape"}
    sales = make(spark, [dict(short_description="chair"), dict(short_description="sofa")])
    got = {r["short_description"]: r["product_category"]
           for r in with_category(sales, product_categories(codes)).collect()}
    assert got == {"chair": "Furniture", "sofa": None}


def test_no_category_column_gives_no_lookup(spark):
    codes = spark.createDataFrame([("chair", "F")], "Description string, other string")
    assert product_categories(codes) is None


def test_ties_at_the_cut_break_by_key(spark):
    rows = [dict(company=c, invoice_no=i, invoice_date=ts("2020-01-01"), total_price=Decimal("5"))
            for i, c in enumerate(["b", "a", "c", "d"])]
    top = [r["customer"] for r in R.top_customers(make(spark, rows), 2).collect()]
    assert top == ["a", "b"]


def test_recency_uses_time_of_day(spark):
    df = make(spark, [dict(company="x", invoice_date=ts("2020-01-01 23:00:00")),
                      dict(company="y", invoice_date=ts("2020-01-03 01:00:00"))])
    got = {r["customer"]: r["days_since_last_purchase"] for r in R.customer_value(df).collect()}
    assert got == {"x": 1, "y": 0}


def test_zero_units_gives_null_average_price(spark):
    df = make(spark, [dict(short_description="p", colour="red", qty=0.0, total_price=Decimal("3")),
                      dict(short_description="p", colour="blue", qty=2.0, total_price=Decimal("3"))])
    got = {r["colour"]: r["avg_price_per_unit"] for r in R.colour_breakdown(df, "p").collect()}
    assert got == {"red": None, "blue": 1.5}


def test_empty_table(spark):
    df = make(spark, [dict(invoice_no=1)]).limit(0)
    k = K.kpis(df).first()
    assert k["total_revenue"] == 0 and k["total_orders"] == 0 and k["aov"] == 0
    assert K.growth(df).count() == 0
    assert R.monthly_revenue(df).count() == 0
    assert S.revenue_series(df).count() == 0


def test_growth_is_zero_when_previous_window_is_empty(spark):
    df = make(spark, [dict(invoice_date=ts("2020-06-01"), total_price=Decimal("10"))])
    g = K.growth(df).first()
    assert g["growth_30_day"] == 0 and g["current_30_day"] == 10


def test_eleven_months_is_too_short_twelve_is_enough(spark):
    assert S.revenue_series(make(spark, monthly_rows(11, per_month=2))).count() == 0
    assert S.revenue_series(make(spark, monthly_rows(12))).count() == 12


def test_lag_12_appears_only_after_twelve_rows(spark):
    f12 = S.month_features(S.revenue_series(make(spark, monthly_rows(12)))).collect()
    assert all(r["lag_12"] == 0 for r in f12)
    f13 = S.month_features(S.revenue_series(make(spark, monthly_rows(13)))).orderBy("month_start").collect()
    assert f13[-1]["lag_12"] == 100 and f13[0]["lag_12"] == 100  # back-filled with the first value


def test_missing_month_counts_rows_not_calendar(spark):
    rows = [r for r in monthly_rows(14) if r["invoice_date"].month != 6 or r["invoice_date"].year != 2020]
    f = S.month_features(S.revenue_series(make(spark, rows))).orderBy("month_start").collect()
    july = [r for r in f if r["month_start"] == ts("2020-07-01")][0]
    assert july["lag_1"] == 104  # May's value: the gap is not filled


def test_product_needs_six_months_and_thirty_lines(spark):
    five = monthly_rows(5, per_month=6, product="p")
    six = monthly_rows(6, per_month=5, product="q")
    assert [r["series_id"] for r in S.demand_series(make(spark, five + six)).select("series_id").distinct().collect()] == ["q"]
    assert S.demand_series(make(spark, monthly_rows(6, per_month=4, product="q") + [
        dict(short_description="q", invoice_date=ts("2020-01-09"), qty=1.0)] * 6)).count() == 6
    # 29 lines in all: too few
    assert S.demand_series(make(spark, monthly_rows(6, per_month=4, product="q") + [
        dict(short_description="q", invoice_date=ts("2020-01-09"), qty=1.0)] * 5)).count() == 0


def test_missing_optional_column(spark):
    df = make(spark, [dict(type="A", colour="red")]).drop("colour")
    vals = {(r["filter_column"], r["value"]) for r in K.filter_values(df).collect()}
    assert vals == {("type", "A")}
    assert K.data_profile(df).first()["missing_columns"] == ""
    assert K.data_profile(df.drop("qty")).first()["missing_columns"] == "qty"


def test_linear_forecast_recovers_a_seasonal_trend(spark):
    rows = []
    for i in range(36):
        y, m = 2018 + i // 12, i % 12 + 1
        amount = (1000 + 10 * i) * (1.5 if m in (11, 12) else 1.0)
        rows.append(dict(invoice_no=i, invoice_date=dt.datetime(y, m, 1),
                         total_price=Decimal(str(round(amount, 4)))))
    f = FL.revenue_forecast(S.revenue_series(make(spark, rows)), 3).orderBy("horizon").collect()
    assert [r["month_start"] for r in f] == [ts("2021-01-01"), ts("2021-02-01"), ts("2021-03-01")]
    assert all(r["lower_ci"] <= r["forecast"] <= r["upper_ci"] for r in f)
    # brute force: the same seasonal-linear recipe in numpy on the same 36 values
    y = np.array([float(r["total_price"]) for r in rows])
    moy = np.array([r["invoice_date"].month for r in rows])
    means = {m: y[moy == m].mean() for m in range(1, 13)}
    overall = np.mean([means[m] for m in range(1, 13)])
    idx = {m: means[m] / overall for m in means}
    yd = y / np.array([idx[m] for m in moy])
    x = np.arange(36.0)
    slope = (36 * np.sum(x * yd) - x.sum() * yd.sum()) / (36 * np.sum(x * x) - x.sum() ** 2)
    icept = (yd.sum() - slope * x.sum()) / 36
    want = [(slope * (36 + i) + icept) * idx[i + 1] for i in range(3)]
    assert [r["forecast"] for r in f] == pytest.approx(want, rel=1e-12)


def test_reports_without_optional_columns_are_empty(spark):
    df = make(spark, [dict(invoice_date=ts("2020-01-01"), company="a", short_description="p",
                           colour="red", delivery_town="t", status="F", item_type="x")])
    bare = df.drop("colour", "delivery_town", "status", "item_type", "short_description", "company")
    assert R.colour_summary(bare).count() == 0 and R.colour_revenue(bare).count() == 0
    assert R.colour_breakdown_all(bare).count() == 0 and R.multi_colour_products(bare).count() == 0
    assert R.top_towns(bare).count() == 0 and R.revenue_by_status(bare).count() == 0
    assert R.item_type_counts(bare).count() == 0 and R.product_table(bare).count() == 0
    assert R.customer_value(bare).count() == 0 and R.top_products(bare).count() == 0
    assert R.colour_summary(df).count() == 1  # and with the columns, rows as usual


def test_us_style_dates_parse_month_first(spark):
    raw = spark.createDataFrame([("1/2/2020",), ("01/02/2020 13:45:00",), ("12/31/2019 7:05",),
                                 ("2020-03-04",), ("31/12/2019",)], "invoice_date string")
    got = [r["invoice_date"] for r in clean_sales(raw).collect()]
    assert got == [ts("2020-01-02"), ts("2020-01-02 13:45:00"), ts("2019-12-31 07:05:00"),
                   ts("2020-03-04"), None]


def test_large_and_fine_amounts_are_kept(spark):
    raw = spark.createDataFrame([("123456789012345678.123456",), ("0.000001",), ("-99999999999999.9999",), ("inf",), ("NaN",), ("x",), (None,)],
                                "total_price string")
    got = [r["total_price"] for r in clean_sales(raw).collect()]
    assert got[:3] == [Decimal("123456789012345678.123456"), Decimal("0.000001"), Decimal("-99999999999999.9999")]
    assert got[3:] == [0, 0, 0, 0]


def test_an_amount_that_does_not_fit_raises(spark):
    from pyspark.errors import SparkRuntimeException
    raw = spark.createDataFrame([("1e30",)], "total_price string")
    with pytest.raises(SparkRuntimeException, match="does not fit"):
        clean_sales(raw).collect()


def test_typed_amounts_are_not_read_as_text(spark):
    raw = spark.createDataFrame([(1e14 + 0.5, 7, 2.5), (float("nan"), None, float("nan")), (float("inf"), 1, 0.0)],
                                "total_price double, price long, qty double")
    got = clean_sales(raw)
    assert "string" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    rows = got.collect()
    assert [r["total_price"] for r in rows] == [Decimal("100000000000000.5"), 0, 0]
    assert [r["price"] for r in rows] == [7, 0, 1] and [r["qty"] for r in rows] == [2.5, 0, 0]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_units_do_not_depend_on_partitioning(spark, parts):
    rows = [dict(invoice_no=i, qty=0.1 * (i % 97) + 1e8 * (i % 3), short_description="p", colour="red") for i in range(3000)]
    df = make(spark, rows).repartition(parts)
    want = float(sum(Decimal(str(round(r["qty"], 6))) for r in rows))
    assert K.kpis(df).first()["total_units"] == want
    assert R.product_table(df).first()["units_sold"] == want
    assert R.colour_units(df).first()["qty"] == want
    assert R.colour_summary(df).first()["units_sold"] == want


def test_infinite_quantity_raises_everywhere(spark):
    df = make(spark, [dict(qty=float("inf"), short_description="p", colour="red", invoice_date=ts("2020-01-01"))])
    for report in (K.kpis, R.product_table, R.colour_units, S.product_month_qty):
        with pytest.raises(Exception, match="not finite"):
            report(df).collect()


def test_flags_strip_unicode_white_space(spark):
    codes = spark.createDataFrame([("a", "F\t"), ("b", "L\n"), ("c", "\u00a0f\u2003"), ("d", "\r\x1c l"), ("e", "F x")],
                                  "description string, furniture string")
    assert {r["description"]: r["category"] for r in product_categories(codes).collect()} == {
        "a": "Furniture", "b": "Landscape", "c": "Furniture", "d": "Landscape"}


def test_filter_on_an_absent_column_raises(spark):
    df = make(spark, [dict(type="A")]).drop("type", "status", "item_type", "furniture_group")
    for flt in (SalesFilter(types=("A",)), SalesFilter(statuses=("A",)), SalesFilter(item_types=("A",))):
        with pytest.raises(ValueError, match="no such column"):
            flt.apply(df)
    assert SalesFilter(furniture_groups=("A",), categories=("B",)).apply(df).count() == 1


def test_headline_figures_without_their_columns(spark):
    df = make(spark, [dict(invoice_no=1, company="a", invoice_date=ts("2020-01-01"), qty=2.0)])
    k = K.kpis(df.drop("company", "qty")).first()
    assert (k["total_customers"], k["total_units"], k["revenue_per_customer"], k["total_orders"]) == (0, 0, 0, 1)
    assert K.kpis(df.drop("total_price")).first()["total_revenue"] == 0
    assert K.growth(df.drop("invoice_date", "year")).count() == 0 and R.monthly_revenue(df.drop("invoice_date")).count() == 0


def test_headline_labels(spark):
    df = make(spark, [dict(invoice_no=i, company=str(i % 7), invoice_date=ts("2020-01-01") + dt.timedelta(days=i),
                           total_price=Decimal("1234.5"), qty=10.0) for i in range(100)])
    k = K.kpis(df).first()
    assert (k["total_revenue_label"], k["total_orders_label"], k["aov_label"], k["total_units_label"]) == (
        f"£{123450:,.0f}", "100", f"£{1234.5:,.0f}", "1,000")
    g = K.growth(df).first()
    assert g["growth_30_day_label"] == f"{g['growth_30_day']:+.1f}%" and g["growth_yoy_label"] == "+0.0%"


@pytest.mark.parametrize("n", [2, 12, 13, 30])
def test_feature_table_has_shift_and_rolling_semantics(spark, n):
    """An independent reading: pandas shift, rolling, pct_change, back-fill then forward-fill then 0."""
    import pandas as pd
    rng = np.random.default_rng(n)
    months = pd.date_range("2019-03-01", periods=n, freq="MS")
    y = pd.Series(np.round(rng.uniform(50, 500, n), 2), index=months)
    s = spark.createDataFrame([("s", m.to_pydatetime(), Decimal(str(v)), float(v)) for m, v in y.items()],
                              f"series_id string, month_start timestamp, y_dec {S.SERIES_DEC}, y double")
    got = S.month_features(s).orderBy("month_start").toPandas()

    def filled(v):
        return v.bfill().ffill().fillna(0).to_numpy()

    want = {f"lag_{k}": filled(y.shift(k)) for k in (1, 2, 3, 12)}
    want |= {f"rolling_mean_{k}": y.rolling(k, min_periods=1).mean().to_numpy() for k in (3, 6)}
    want["rolling_std_3"] = y.rolling(3, min_periods=1).std().fillna(0).to_numpy()
    want["yoy_growth"] = (y / y.shift(12) - 1).fillna(0).to_numpy()
    want["seasonal_index"] = (y.groupby(months.month).transform("mean") / y.mean()).to_numpy()
    want["month"], want["quarter"], want["months_since_start"] = months.month, months.quarter, np.arange(n)
    for name, values in want.items():
        assert got[name].to_numpy() == pytest.approx(np.asarray(values, float), rel=1e-9, abs=1e-9), name


def test_orders_of_repeated_and_null_invoices(spark):
    rows = [dict(invoice_no=n, short_description="p", colour=c) for n, c in
            [(1, "red"), (1, "red"), (2, "red"), (None, "red"), (None, "red"), (1, "blue"), (None, "green")]]
    got = {r["colour"]: (r["orders"], r["units_sold"]) for r in R.colour_breakdown_all(make(spark, rows)).collect()}
    assert got == {"red": (2, 5.0), "blue": (1, 1.0), "green": (0, 1.0)}
