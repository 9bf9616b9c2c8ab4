"""Reports from mergeable rollups.

A rollup holds, for every report key, its values and the calendar day: the number of lines, exact
sums of revenue and units, and the number of null cells. Rollups of two sets of lines add up to
that of both, and what is taken out of a table is subtracted, so every part of a snapshot keeps
its own (``sources.storage``) and reports read no lines. Day grain keeps date ranges possible
(``between``); filters on values need the lines.

Rows: (dimension, value, day, lines, revenue, units, cells). Dimension ``line`` has one null value
and counts every line once; the others are named after their column. A null value is a row of
its own, as is the null day of undated lines.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as LF
from ..schema import EXPECTED_COLUMNS, FILTER_VALUE_COLUMNS, MONEY
from .kpis import GROWTH_WINDOWS
from .reports import with_report_columns

ALL = "line"
DIMENSIONS = ["type", "status", "payment_method", "short_description", "item_type", "delivery_town", "colour",
              "product_category", "furniture_group"]
ROLLUP_SCHEMA = ("dimension string, value string, day date, lines long, revenue decimal(38,6), units decimal(38,6), cells long")
KEYS = ("dimension", "value", "day")
MEASURES = ("lines", "revenue", "units", "cells")


# Sums are built in whole numbers: an amount of decimal(30,6) is three of them of up to ten digits,
# so every sum is exact and holds for 900 million lines of one key and day (beyond, ANSI raises).
LIMB = 10 ** 10
LIMBS = (("_high", Decimal("1e14")), ("_mid", Decimal(LIMB) / 10 ** 6), ("_low", Decimal("0.000001")))


def _in_limbs(lines: DataFrame, name: str) -> DataFrame:
    """``name`` of decimal(30,6) as its three limbs, all of its sign; null stays null."""
    x = F.col(name)
    # digits in front of the point: most amounts have no more than twelve, and fit a long as they are
    short = F.abs(x) < F.lit(10 ** 12)
    micros, u = f"_{name}_micros", f"_{name}_u"
    parted = lines.withColumns({micros: F.when(short, (x * F.lit(10 ** 6)).cast("long")), u: F.when(~short, x * F.lit(10 ** 6))})
    places = {"_high": f"coalesce(if(`{micros}` IS NULL, NULL, 0L), `{u}` div {LIMB ** 2}BD)",
              "_mid": f"coalesce(`{micros}` div {LIMB}L, (`{u}` % {LIMB ** 2}BD) div {LIMB}BD)",
              "_low": f"coalesce(`{micros}` % {LIMB}L, cast(`{u}` % {LIMB}BD AS BIGINT))"}
    return parted.withColumns({name + limb: F.expr(e) for limb, e in places.items()}).drop(name, micros, u)


def _from_limbs(name: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(name + limb).cast("decimal(19,0)") * F.lit(unit) for limb, unit in LIMBS]).cast("decimal(38,6)")


def prepared(lines: DataFrame, *keep: str) -> DataFrame:
    """What a rollup reads of some lines, one row each."""
    columns = [c for c in lines.columns if c not in keep]
    empty_cells = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns], F.lit(0))
    full = with_report_columns(lines.withColumn("_cells", empty_cells))
    kind = full.schema["total_price"].dataType
    exact = isinstance(kind, T.DecimalType) and kind.scale <= MONEY.scale and kind.precision - kind.scale <= MONEY.precision - MONEY.scale
    revenue = F.col("total_price").cast(MONEY) if exact else F.col("total_price")
    rows = full.select(*keep, F.to_date("invoice_date").alias("day"), revenue.alias("revenue"), LF.exact_measure("qty").alias("units"),
                       F.col("_cells"), *[F.col(d).cast("string").alias(d) for d in DIMENSIONS if d in columns])
    return _in_limbs(_in_limbs(rows, "units"), "revenue") if exact else _in_limbs(rows, "units")


def added_up(rows: DataFrame, *keep: str) -> DataFrame:
    """The rollup of ``prepared`` lines. Each line counts once in every dimension; sums are built in
    each task before the shuffle."""
    names = [ALL, *DIMENSIONS]
    entries = [F.struct(F.lit(0).alias("_at"), F.lit(None).cast("string").alias("value"))] + [
        F.struct(F.lit(names.index(d)).alias("_at"), F.col(d).alias("value")) for d in DIMENSIONS if d in rows.columns]
    parts = [c for c in rows.columns if c.startswith(("revenue", "units"))]
    flat = rows.select(*keep, "day", "_cells", *parts, F.explode(F.array(*entries)).alias("e")).select("*", "e.*")
    sums = flat.groupBy(*keep, "_at", "value", "day").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("_cells").cast("long").alias("cells"), *[F.sum(c).alias(c) for c in parts])
    total = {c: F.col(c).cast("decimal(38,6)") if c in parts else _from_limbs(c) for c in ("revenue", "units")}
    dimension = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_at") + 1)
    return sums.select(*keep, dimension.alias("dimension"), "value", "day", "lines", total["revenue"].alias("revenue"),
                       total["units"].alias("units"), "cells")


def roll_up(lines: DataFrame, *keep: str) -> DataFrame:
    """The rollup of some lines; ``keep`` names further columns to keep them apart by."""
    return added_up(prepared(lines, *keep), *keep)


def negative(rollup: DataFrame) -> DataFrame:
    """What a rollup takes out of another."""
    return rollup.withColumns({c: -F.col(c) for c in MEASURES})


def merged(rollup: DataFrame) -> DataFrame:
    """Rollups of several sets of lines, added up; what is left without lines is gone."""
    return (rollup.groupBy(*KEYS).agg(*[F.sum(c).cast("decimal(38,6)" if c in ("revenue", "units") else "long").alias(c)
                                        for c in MEASURES]).filter("lines > 0"))


def between(rollup: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """F1 on a rollup: the days of an inclusive range; undated lines never match."""
    return rollup.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _of(rollup: DataFrame, dimension: str) -> DataFrame:
    return rollup.filter((F.col("dimension") == dimension) & F.col("value").isNotNull())


def _sums(rollup: DataFrame, dimension: str, key: str, *sums: Column) -> DataFrame:
    return _of(rollup, dimension).groupBy(F.col("value").alias(key)).agg(*sums)


def _revenue(name: str = "total_price") -> Column:
    return F.sum("revenue").alias(name)


def _units(name: str) -> Column:
    return F.sum("units").cast("double").alias(name)


def _by_value(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.orderBy(F.col(column).desc(), F.col(key))


def _money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: LF.money_out(c) for c in columns})


def _by_period(rollup: DataFrame, period: str, label) -> DataFrame:
    dated = rollup.filter((F.col("dimension") == ALL) & F.col("day").isNotNull())
    sums = dated.groupBy(F.date_trunc(period, F.col("day").cast("timestamp")).alias("_start")).agg(_revenue())
    return _money(sums.select(label("_start").alias(period), "total_price"), "total_price").orderBy(period)


def monthly_revenue(rollup: DataFrame) -> DataFrame:
    """A3"""
    return _by_period(rollup, "month", LF.month_label)


def quarterly_revenue(rollup: DataFrame) -> DataFrame:
    """A5"""
    return _by_period(rollup, "quarter", LF.quarter_label)


def revenue_by_type(rollup: DataFrame) -> DataFrame:
    """A4"""
    return _money(_by_value(_sums(rollup, "type", "type", _revenue()), "total_price", "type"), "total_price")


def revenue_by_status(rollup: DataFrame) -> DataFrame:
    """A6"""
    return _money(_sums(rollup, "status", "status", _revenue()), "total_price").orderBy("status")


def revenue_by_payment(rollup: DataFrame) -> DataFrame:
    """A19"""
    return _money(_sums(rollup, "payment_method", "payment_method", _revenue()), "total_price").orderBy("payment_method")


def top_products(rollup: DataFrame, k: int = 10) -> DataFrame:
    """A9 + K2"""
    sums = _sums(rollup, "short_description", "product", _revenue())
    return _money(_by_value(sums, "total_price", "product").limit(k), "total_price")


def item_type_counts(rollup: DataFrame) -> DataFrame:
    """A10"""
    return _by_value(_sums(rollup, "item_type", "item_type", F.sum("lines").alias("count")), "count", "item_type")


def product_table(rollup: DataFrame, k: int = 20) -> DataFrame:
    """A11 + K2"""
    sums = _sums(rollup, "short_description", "product", _revenue("revenue"), _units("units_sold"))
    return _by_value(sums, "revenue", "product").limit(k).select(
        "product", LF.money_out("revenue").alias("revenue"), "units_sold", LF.currency_label("revenue").alias("revenue_label"))


def _coloured(rollup: DataFrame) -> DataFrame:
    return rollup.filter("value <> ''")


def colour_revenue(rollup: DataFrame) -> DataFrame:
    """A12"""
    return _money(_by_value(_sums(_coloured(rollup), "colour", "colour", _revenue()), "total_price", "colour"), "total_price")


def colour_units(rollup: DataFrame) -> DataFrame:
    """A13"""
    return _by_value(_sums(_coloured(rollup), "colour", "colour", _units("qty")), "qty", "colour")


def top_towns(rollup: DataFrame, k: int = 15) -> DataFrame:
    """A18 + K3"""
    sums = _sums(rollup, "delivery_town", "delivery_town", _revenue())
    return _money(_by_value(sums, "total_price", "delivery_town").limit(k), "total_price")


def filter_values(rollup: DataFrame) -> DataFrame:
    """The dictionaries of the filter columns."""
    return (rollup.filter(F.col("dimension").isin(FILTER_VALUE_COLUMNS) & F.col("value").isNotNull())
            .select(F.col("dimension").alias("filter_column"), "value").distinct().orderBy("filter_column", "value"))


def data_profile(rollup: DataFrame, columns: list[str]) -> DataFrame:
    """A26 of a table with these ``columns``."""
    missing = [c for c in EXPECTED_COLUMNS if c not in columns]
    agg = rollup.filter(F.col("dimension") == ALL).agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("cells"), F.lit(0)).alias("_nulls"),
        F.min("day").alias("_min"), F.max("day").alias("_max"))
    cells = F.col("row_count") * F.lit(len(columns))
    return agg.select(
        "row_count", F.lit(len(columns)).cast("long").alias("column_count"), F.lit(", ".join(missing)).alias("missing_columns"),
        F.when(cells > 0, (F.lit(1.0) - F.col("_nulls") / cells) * 100.0).alias("completeness_pct"),
        F.date_format("_min", "yyyy-MM-dd").alias("min_date"), F.date_format("_max", "yyyy-MM-dd").alias("max_date"))


def growth(rollup: DataFrame, lines: DataFrame) -> DataFrame:
    """A2: whole days inside a window come from the rollup; of the lines only the days are read
    that a window begins on and the latest one, for the time of day of the anchor."""
    days = rollup.filter((F.col("dimension") == ALL) & F.col("day").isNotNull()).select("day", "revenue")
    last = days.agg(F.max("day").alias("last"))
    begins = sorted({n * k for _, n in GROWTH_WINDOWS for k in (1, 2)})
    since = lambda n: F.date_sub(last.select("last").scalar(), n)
    t = F.col("invoice_date")
    on_edge = reduce(lambda a, b: a | b, [(t >= since(n).cast("timestamp")) & (t < F.date_add(since(n), 1).cast("timestamp"))
                                          for n in [0, *begins]])
    edge = lines.where(on_edge)
    if "year" in lines.columns:  # prunes the snapshot's years
        edge = edge.where(reduce(lambda a, b: a | b, [F.col("year") == F.year(since(n)) for n in [0, *begins]]))
    edge = edge.select(t.alias("at"), F.col("total_price").alias("amount"))
    anchor = edge.agg(F.max("at").alias("anchor"))
    a = F.unix_micros(anchor.select("anchor").scalar())
    whole = days.where(reduce(lambda x, y: x & y, [F.col("day") != since(n) for n in [0, *begins]]))
    both = whole.select(F.col("day").cast("timestamp").alias("at"), F.col("revenue").alias("amount")).unionByName(
        edge.select("at", F.col("amount").cast("decimal(38,6)").alias("amount")))
    at, day = F.unix_micros("at"), LF.MICROS_PER_DAY
    sums = []
    for name, n in GROWTH_WINDOWS:
        now, before = at >= a - n * day, (at >= a - 2 * n * day) & (at < a - n * day)
        sums += [F.coalesce(F.sum(F.when(now, F.col("amount"))), F.lit(0)).alias(f"_{name}_cur"),
                 F.coalesce(F.sum(F.when(before, F.col("amount"))), F.lit(0)).alias(f"_{name}_prev")]
    g = both.agg(*sums, anchor.select("anchor").scalar().alias("anchor")).where("anchor IS NOT NULL")
    return g.select(
        *[LF.growth_pct(F.col(f"_{name}_cur"), F.col(f"_{name}_prev")).alias(f"growth_{name}") for name, _ in GROWTH_WINDOWS],
        F.col("_30_day_cur").cast("double").alias("current_30_day"), F.col("_30_day_prev").cast("double").alias("previous_30_day"),
        F.col("anchor").alias("anchor_date"),
    ).withColumns({f"growth_{name}_label": LF.signed_pct_label(f"growth_{name}") for name, _ in GROWTH_WINDOWS})
