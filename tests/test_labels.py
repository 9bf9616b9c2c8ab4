"""Display labels follow Python's own formatting (the source formats with f-strings)."""

import pytest
from pyspark.sql import functions as F

from ledgerlens import functions as LF

VALUES = [1234.5, 2.5, 3.5, -1234.5, -0.3, 1000000.5, 0.125, 2.675, 1234567.891, 0.0, 12.0]


@pytest.fixture(scope="module")
def labels(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    return df.select(
        "x",
        LF.currency_label("x").alias("cur0"),
        LF.currency_label("x", 2).alias("cur2"),
        LF.signed_pct_label("x").alias("spct"),
        LF.plain_number("x", 0).alias("plain0"),
        LF.pct_label(F.col("x") / 100).alias("pct"),
        LF.ratio_2dp("x", F.lit(1.0)).alias("r2"),
    ).collect()


def test_currency_labels_match_python(labels):
    for r in labels:
        assert r["cur0"] == f"£{r['x']:,.0f}"
        assert r["cur2"] == f"£{r['x']:,.2f}"


def test_plain_and_signed_labels_match_python(labels):
    for r in labels:
        assert r["plain0"] == f"{r['x']:.0f}"
        assert r["spct"] == f"{r['x']:+.1f}%"


def test_two_decimal_rounding_is_half_even_on_the_value(labels):
    got = {r["x"]: r["r2"] for r in labels}
    assert got[0.125] == 0.12 and got[2.5] == 2.5


def test_title_and_month_labels(spark):
    r = spark.range(1).select(
        LF.title_label(F.lit("rolling_mean_3")).alias("t"),
        LF.long_month_label(F.lit("2020-05-01").cast("timestamp")).alias("m"),
        LF.quarter_label(F.lit("2020-05-01").cast("timestamp")).alias("q")).first()
    assert (r["t"], r["m"], r["q"]) == ("Rolling Mean 3", "May 2020", "2020Q2")
