"""Layouts of text dates against pandas, and histogram edges on the 1-2-5 ladder."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import dates
from ledgerlens.operators.reports import nice_recency_histogram, nice_width
from ledgerlens.sources.load import read_sales

COLUMNS = {
    "iso": ["2020-01-31", "2020-02-01", "31/01/2020", None, "2020-1-5"],
    "day_first": ["31/01/2020", "01/02/2020", "13/13/2020", "2020-01-01", "5/6/2021"],
    "month_first": ["01/02/2020", "12/31/2020", "31/12/2020", "", "1/1/1999"],
    "compact": ["20200131", "20201301", "19991231", "2020-01-31", "x"],
    "month_name": ["5 Jan 2020", "31 December 2020", "17 Feb 1999", "Jan 5 2020", None],
    "long_name": ["January 5, 2020", "March 31, 2021", "Feb 1, 2020", "February 30, 2020", None],
    "dashed_name": ["05-Jan-2020", "31-DEC-1999", "1-feb-2001", "2020-01-05", "-"],
    "dotted": ["31.01.2020", "01.02.2020", "12.12.2012", "1.13.2012", None],
    "stamped": ["2020-01-31 13:05:09", "2020-02-01 00:00:00", "2020-02-01", "2020-02-01T01:02:03", None],
    "t_stamped": ["2020-01-31T13:05:09", "2020-02-01T00:00:00", "2020-02-01 01:02:03", None, ""],
    "us_stamped": ["12/31/2020 1:05 PM", "1/2/2020 12:00 AM", "1/2/2020", "13/1/2020 1:00 PM", None],
    "blank_first": [None, "", "not a date", "31/01/2020", "01/02/2020"],
    "none": [None, "", "x", "12", "13:05"],
}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, *[v[i] for v in COLUMNS.values()]) for i in range(5)]
    return spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} string" for c in COLUMNS)).repartition(3)


def test_layouts_equal_pandas(spark, table):
    found = dates.infer_layouts(table, list(COLUMNS), F.col("i"))
    assert found["day_first"] == "d/M/yyyy" and found["month_first"] == "M/d/yyyy" and found["none"] is None
    for name, texts in COLUMNS.items():
        if found[name] is None or name == "us_stamped":  # pandas has no one layout with a 12-hour clock
            continue
        got = [r[0] for r in table.orderBy("i").select(dates.parse(F.col(name), found[name])).collect()]
        # pandas guesses from the first value: the texts before the first date are left out there
        start = next(i for i, r in enumerate(got) if r is not None)
        want = [None if pd.isna(x) else x.to_pydatetime() for x in pd.to_datetime(pd.Series(texts[start:]), errors="coerce")]
        assert got[:start] == [None] * start and got[start:] == want, name


def test_twelve_hour_clock(table):
    found = dates.infer_layouts(table, ["us_stamped"], F.col("i"))
    got = [str(r[0]) for r in table.orderBy("i").select(dates.parse(F.col("us_stamped"), found["us_stamped"])).collect()]
    assert got == ["2020-12-31 13:05:00", "2020-01-02 00:00:00", "None", "None", "None"]


def test_one_pass_counts_the_layouts(table):
    rows = {(r["column"], r["layout"]): r["values"] for r in dates.layout_counts(table, ["iso", "none"], F.col("i")).collect()}
    assert rows == {("iso", "yyyy-M-d"): 3, ("iso", "d/M/yyyy"): 1, ("none", None): 4}
    assert dates.infer_layouts(table, []) == {}
    assert dates.infer_layouts(table.limit(0), ["iso"]) == {"iso": None}


def test_exports_with_guessed_dates(spark):
    d = tempfile.mkdtemp(prefix="ll-dates-")
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/a.csv", "w") as f:
        f.write("Invoice No,Invoice Date,Order Date\n1,31/01/2020,5 Jan 2020\n2,01/02/2020,6 Jan 2020\n3,bad,2020-01-01\n")
    rows = {r["invoice_no"]: r for r in read_sales(spark, f"{d}/in", fmt="csv", guess_dates=True).collect()}
    assert [rows[k]["year_month"] for k in "123"] == ["2020-01", "2020-02", None]
    assert str(rows["2"]["order_date"]) == "2020-01-06 00:00:00" and rows["3"]["order_date"] is None
    usual = {r["invoice_no"]: r for r in read_sales(spark, f"{d}/in", fmt="csv").collect()}
    assert usual["1"]["invoice_date"] is None and usual["2"]["year_month"] == "2020-01"  # month first, value by value


def plain_width(lo, hi, bins):
    return next(m * 10 ** k for k in range(18) for m in (1, 2, 5) if hi // (m * 10 ** k) - lo // (m * 10 ** k) + 1 <= bins)


def test_widths_at_powers_of_ten(spark):
    cases = [(0, 0), (0, 24), (0, 25), (1, 25), (24, 49), (0, 49), (0, 50), (0, 99), (0, 100), (99, 100), (0, 124), (0, 125), (0, 249), (0, 250),
             (7, 999), (0, 1000), (999, 1000), (0, 9999), (0, 10_000), (0, 10 ** 9), (10 ** 9 - 1, 10 ** 9), (5, 2524)]
    df = spark.createDataFrame(cases, "lo long, hi long")
    for bins in (1, 10, 25):
        got = [r[0] for r in df.select(nice_width(F.col("lo"), F.col("hi"), bins)).collect()]
        want = [next((m * 10 ** k for k in range(18) for m in (1, 2, 5) if hi // (m * 10 ** k) - lo // (m * 10 ** k) + 1 <= bins), None)
                for lo, hi in cases]
        assert got == want and all(w in (1, 2, 5) or w % 10 == 0 for w in got)
    assert plain_width(0, 2524, 25) == 200


def test_histogram_edges(spark):
    base = pd.Timestamp("2020-12-31")
    rows = [(f"c{i}", (base - pd.Timedelta(days=d)).to_pydatetime(), 1, "1.0") for i, d in enumerate([0, 1, 99, 100, 101, 250, 999, 1000])]
    sales = spark.createDataFrame(rows, "company string, invoice_date timestamp, invoice_no long, price string").withColumn(
        "total_price", F.col("price").cast("decimal(30,6)"))
    got = [tuple(r) for r in nice_recency_histogram(sales).collect()]
    assert got == [(0, 50, 2), (50, 100, 1), (100, 150, 2), (250, 300, 1), (950, 1000, 1), (1000, 1050, 1)]
    assert [tuple(r) for r in nice_recency_histogram(sales, 5).collect()] == [(0, 500, 6), (500, 1000, 1), (1000, 1500, 1)]
    assert nice_recency_histogram(sales.limit(0)).collect() == []
