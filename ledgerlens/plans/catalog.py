"""Registered queries: each binds the data folder to one operator.

``QUERIES[name](spark, sf_dir) -> DataFrame``. Every query reads the given
tables (or a fresh snapshot Spark derived from them) in full; limits appear
only where the report is a top-k list. Decimal money columns are cast to
double at this boundary so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import sources
from ..operators import forecast_gbt as FG
from ..operators import forecast_linear as FL
from ..operators import kpis as K
from ..operators import reports as R
from ..operators import rollups as RU
from ..operators import series as S
from ..operators.filters import SalesFilter
from ..sources import storage
from ..sources.fixtures import product_codes
from ..sources.load import product_categories
from ..schema import OPTIONAL_COLUMNS, SOURCE_NAMES
from ..session import configure

# Parameters of the registered filter queries. The date range, types and status are
# the combined filter of FIXTURES.md section 4; item types and brands are values that
# occur in the data.
DATE_RANGE = ("1997-01-01", "1999-12-31")
TYPES = ("BUILDING", "MACHINERY")
STATUSES = ("F",)
CATEGORIES = ("Furniture",)
ITEM_TYPES = ("LARGE", "SMALL")
FURNITURE_GROUPS = ("Brand#1", "Brand#12", "Brand#7")

FILTERS = {
    "filter_date": SalesFilter(date_start=DATE_RANGE[0], date_end=DATE_RANGE[1]),
    "filter_type": SalesFilter(types=TYPES),
    "filter_status": SalesFilter(statuses=STATUSES),
    "filter_category": SalesFilter(categories=CATEGORIES),
    "filter_item_type": SalesFilter(item_types=ITEM_TYPES),
    "filter_furniture_group": SalesFilter(furniture_groups=FURNITURE_GROUPS),
    "filter_combined": SalesFilter(date_start=DATE_RANGE[0], date_end=DATE_RANGE[1],
                                   types=TYPES, statuses=STATUSES),
}


def decimals_to_double(df: DataFrame) -> DataFrame:
    dec = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in dec}) if dec else df


# Calendar parts of a line are null when its date is; as double they read the same
# (NaN) from every engine, while a nullable integer column does not.
DATE_PARTS = ("year", "month", "quarter")


def row_output(df: DataFrame) -> DataFrame:
    """Row-level results: money and nullable calendar parts as double."""
    df = decimals_to_double(df)
    parts = [c for c in DATE_PARTS if c in df.columns]
    return df.withColumns({c: F.col(c).cast("double") for c in parts}) if parts else df


def _on_sales(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decimals_to_double(op(sources.sales(spark, sf_dir)))
    run.__name__ = getattr(op, "__name__", "query")
    run.__doc__ = op.__doc__
    return run


def _rolled(from_rollup: Callable, from_lines: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A report from the rollups of a fresh snapshot, or from the lines without one."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = sources.sales(spark, sf_dir)
        rollup = storage.fresh_rollups(spark, sf_dir)
        return decimals_to_double(from_lines(lines) if rollup is None else from_rollup(rollup, lines))
    run.__name__, run.__doc__ = from_lines.__name__, from_lines.__doc__
    return run


def _filtered(flt: SalesFilter) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return row_output(flt.apply(sources.sales(spark, sf_dir)))
    return run


def load_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + P1-P3: the all-text export coerced to the typed table."""
    return row_output(sources.sales_from_raw(spark, sf_dir))


def product_category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + P4: description -> category."""
    return product_categories(product_codes(spark, sf_dir))


def sales_by_category(sales: DataFrame) -> DataFrame:
    """Lines and revenue per category after the lookup join (null = unmapped)."""
    return (sales.groupBy("product_category")
            .agg(F.count(F.lit(1)).alias("lines"), F.sum("total_price").alias("revenue")))


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + S4: write the cleaned table as a year-partitioned snapshot, read it back."""
    return row_output(storage.snapshot_roundtrip(spark, sources.sales(spark, sf_dir)))


def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + S1: export the typed lines as CSV and load them back through the reader.

    The CSV reader takes every column as text, so ``invoice_no`` comes back as text.
    """
    configure(spark)
    lines = sources.sales_lines(spark, sf_dir)
    k, c = F.col("invoice_no") % 11, F.col("company")
    # text that a careless export loses: line breaks, quotes, backslashes, blanks at the ends,
    # the empty text and the null marker itself
    odd = (F.when(k == 0, F.concat(c, F.lit("\nsecond line"))).when(k == 1, F.concat(F.lit('"'), c, F.lit('", x')))
           .when(k == 2, F.concat(F.lit("\\"), c, F.lit("\\"))).when(k == 3, F.concat(F.lit("  "), c, F.lit(" ")))
           .when(k == 4, F.lit("\\N")).when(k == 5, F.lit("")).when(k == 6, F.lit("\\\\N")).otherwise(c))
    return row_output(storage.export_roundtrip(spark, lines.withColumn("company", odd)))


# Fixed parameters of the registered forecast queries (the source's defaults).
HORIZON = 6
TOP_N = 5


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def _series_out(df: DataFrame) -> DataFrame:
    return df.drop("y_dec")


def _revenue_forecast(sales: DataFrame) -> DataFrame:
    return FL.revenue_forecast(S.revenue_series(sales), HORIZON)


def _demand_forecast(sales: DataFrame) -> DataFrame:
    return FL.demand_forecast(S.demand_series(sales, TOP_N), HORIZON)


def _demand_summary(sales: DataFrame) -> DataFrame:
    series = S.demand_series(sales, TOP_N).checkpoint(eager=True)
    return FL.demand_summary(series, FL.demand_forecast(series, HORIZON), "Seasonal Linear")


def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 as a stream: a snapshot of a third of the invoices, the others exported in two
    batches that the stream picks up and appends with their category; the snapshot then."""
    from ..session import scratch_dir
    from ..streaming.refresh import refresh_snapshot
    configure(spark)
    base = scratch_dir(spark, "incremental")
    lines, cats = sources.sales_lines(spark, sf_dir), sources.stored_categories(spark, sf_dir)
    third = F.col("invoice_no") % 3
    snapshot = f"{base}/snapshot"
    storage.write_snapshot(sources.with_category(sources.clean_sales(lines.where(third == 0)), cats), snapshot)
    for batch in (1, 2):
        storage.export_csv(lines.where(third == batch), f"{base}/incoming/batch-{batch}", "gzip")
        refresh_snapshot(spark, f"{base}/incoming", snapshot, f"{base}/checkpoint", cats)
    return row_output(storage.read_snapshot(spark, snapshot, storage.SNAPSHOT_COLUMNS))


# Headers of a sales sheet, and how the registered refresh queries change its exports.
DISPLAY_NAMES = {c: name for name, c in {**SOURCE_NAMES, **OPTIONAL_COLUMNS}.items()}


def refresh_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S7: three exports of all invoices, their columns in different orders under display
    and own names, one without the colour, one with a column nobody knows; the snapshot."""
    from ..session import scratch_dir
    from ..streaming.refresh import refresh_snapshot
    configure(spark)
    base = scratch_dir(spark, "headers")
    lines, third = sources.sales_lines(spark, sf_dir), F.col("invoice_no") % 3
    names = lines.columns
    shapes = [[F.col(c) for c in reversed(names)],
              [F.col(c).alias(DISPLAY_NAMES[c]) for c in names if c != "colour"],
              [F.col(c) for c in names[7:]] + [F.lit("x").alias("Shelf")] + [F.col(c).alias(DISPLAY_NAMES[c]) for c in names[:7]]]
    for i, shape in enumerate(shapes):
        storage.export_csv(lines.where(third == i).select(*shape), f"{base}/incoming/batch-{i}", "gzip")
    refresh_snapshot(spark, f"{base}/incoming", f"{base}/snapshot", f"{base}/checkpoint", sources.stored_categories(spark, sf_dir))
    return row_output(storage.read_snapshot(spark, f"{base}/snapshot", storage.SNAPSHOT_COLUMNS))


def _corrected(lines: DataFrame) -> DataFrame:
    """An export as it is written again: lines removed, changed and doubled."""
    kept = lines.where("invoice_no % 10 <> 1").withColumn(
        "qty", F.when(F.col("invoice_no") % 10 == 2, F.col("qty") + 1).otherwise(F.col("qty")))
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("invoice_no") % 10 == 3, 2).otherwise(1)))).drop("_copy")


def _corrected_snapshot(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A third of the invoices as the base, the others as two exports, of which the first is written
    again with lines removed, changed and doubled: the snapshot after the refresh."""
    from ..session import scratch_dir
    from ..streaming.refresh import refresh_snapshot
    configure(spark)
    base = scratch_dir(spark, "corrections")
    lines, cats = sources.sales_lines(spark, sf_dir), sources.stored_categories(spark, sf_dir)
    third, snapshot = F.col("invoice_no") % 3, f"{base}/snapshot"
    storage.write_snapshot(sources.with_category(sources.clean_sales(lines.where(third == 0)), cats), snapshot)
    for batch in (1, 2):
        storage.export_csv(lines.where(third == batch), f"{base}/incoming/batch-{batch}", "gzip")
    refresh_snapshot(spark, f"{base}/incoming", snapshot, f"{base}/checkpoint", cats)
    storage.export_csv(_corrected(lines.where(third == 1)), f"{base}/incoming/batch-1", "gzip")
    refresh_snapshot(spark, f"{base}/incoming", snapshot, f"{base}/checkpoint", cats)
    return snapshot, storage.read_snapshot(spark, snapshot, storage.SNAPSHOT_COLUMNS)


def refresh_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a snapshot whose first export was written again, corrected."""
    return row_output(_corrected_snapshot(spark, sf_dir)[1])


# Layouts in which ``date_layouts`` writes the order dates, and the one its first value reads as.
WRITTEN_LAYOUTS = {"iso": "yyyy-MM-dd", "day_first": "dd/MM/yyyy", "month_name": "d MMM yyyy", "compact": "yyyyMMdd",
                   "stamped": "MM/dd/yyyy h:mm a"}


def date_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' dates as text in five layouts, each column's layout found from its first
    value (by order key, of the orders placed after the twelfth of a month) and all read by it."""
    from ..functions import dates
    configure(spark)
    orders = sources.fixtures.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    texts = orders.select("o_orderkey", "at", *[F.date_format("at", layout).alias(name) for name, layout in WRITTEN_LAYOUTS.items()])
    # dates up to the twelfth read either way round come after the others
    position = F.when(F.dayofmonth("at") > 12, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + F.lit(2 ** 62))
    found = dates.infer_layouts(texts, list(WRITTEN_LAYOUTS), position)
    rows = [texts.agg(F.lit(name).alias("written"), F.lit(layout).alias("layout"), F.count(F.lit(1)).alias("lines"),
                      F.count_if(dates.parse(F.col(name), layout) == F.col("at")).alias("equal"))
            for name, layout in found.items()]
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other)
    return out


def rollup_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3-A6, A9-A13, A18, A19 from rollups alone: the snapshot of ``refresh_corrections``, its
    parts' rollups added up and the corrected lines' taken out; every dimension and month."""
    path, _ = _corrected_snapshot(spark, sf_dir)
    rollup = storage.read_rollups(spark, path, storage.read_manifest(spark, path))
    month = F.date_format("day", "yyyy-MM")
    return decimals_to_double(rollup.groupBy("dimension", "value", month.alias("month")).agg(
        F.sum("lines").alias("lines"), F.sum("revenue").alias("revenue"), F.sum("units").alias("units")))


def rollup_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 from rollups and the lines of the windows' first days, on the same snapshot."""
    path, lines = _corrected_snapshot(spark, sf_dir)
    return RU.growth(storage.read_rollups(spark, path, storage.read_manifest(spark, path)), lines)


def rollup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26 from rollups, on the same snapshot."""
    path, lines = _corrected_snapshot(spark, sf_dir)
    return RU.data_profile(storage.read_rollups(spark, path, storage.read_manifest(spark, path)), lines.columns)


def snapshot_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + S4: the table appended in eight batches, small parts merged by twos after each; the lines,
    and whether the parts are fewer than the batches."""
    from ..session import scratch_dir
    from ..sources.compaction import compact
    configure(spark)
    path = scratch_dir(spark, "compaction")
    lines = sources.with_category(sources.clean_sales(sources.sales_lines(spark, sf_dir)), sources.stored_categories(spark, sf_dir))
    for batch in range(8):
        storage.append_part(lines.where(F.col("invoice_no") % 8 == batch), path, ("batches", batch))
        compact(spark, path, fan_in=2)
    merged = len(storage.read_manifest(spark, path)["parts"]) < 8
    return row_output(storage.read_snapshot(spark, path, storage.SNAPSHOT_COLUMNS)).withColumn("merged", F.lit(merged))


def _demand_gbt(sales: DataFrame) -> DataFrame:
    """The panel is every product with enough history; the top ones are shown."""
    return FG.demand_forecast(S.demand_series(sales, None), HORIZON, S.top_demand_products(sales, TOP_N))


def _demand_summary_gbt(sales: DataFrame) -> DataFrame:
    series = S.demand_series(sales, TOP_N).checkpoint(eager=True)
    return FL.demand_summary(series, _demand_gbt(sales), "Gradient Boosted Trees")


def _demand_gbt_checks(sales: DataFrame) -> DataFrame:
    return _demand_gbt(sales).select("series_id", "month_start", "horizon",
                                     (F.col("forecast") >= 0).alias("non_negative"))


def _table_gbt_checks(sales: DataFrame) -> DataFrame:
    """Labels of the boosted forecast table against the forecast's own values."""
    f = FG.revenue_forecast(S.revenue_series(sales), HORIZON).checkpoint(eager=True)
    t = FL.forecast_table(f).join(f.drop("month"), ["series_id", "month_start"])
    low, high = (F.concat(F.lit("£"), F.format_number(c, 0)) for c in ("lower_ci", "upper_ci"))
    return t.select("series_id", "month_start", "month",
                    (F.col("predicted_revenue") == F.concat(F.lit("£"), F.format_number("forecast", 0))).alias("value_agrees"),
                    (F.col("confidence_range") == F.concat(low, F.lit(" - "), high)).alias("range_agrees"))


def _totals_gbt_checks(sales: DataFrame) -> DataFrame:
    f = FG.revenue_forecast(S.revenue_series(sales), HORIZON).checkpoint(eager=True)
    again = f.groupBy("series_id").agg(F.sum("forecast").alias("_total"))
    return FL.forecast_totals(f).join(again, "series_id").select(
        "series_id", F.col("months").cast("long").alias("months"),
        (F.abs(F.col("total_forecast") - F.col("_total")) <= 1e-9 * F.col("_total")).alias("total_agrees"),
        (F.abs(F.col("avg_monthly") * F.col("months") - F.col("_total")) <= 1e-9 * F.col("_total")).alias("average_agrees"))


def _summary_gbt_checks(sales: DataFrame) -> DataFrame:
    s = _demand_summary_gbt(sales)
    change = F.when(F.col("hist_avg") > 0, (F.col("forecast_avg") / F.col("hist_avg") - 1.0) * 100.0).otherwise(0.0)
    return s.select("product", "hist_avg", "hist_avg_label",
                    (F.abs(F.col("expected_change_pct") - change) <= 1e-9).alias("change_agrees"),
                    (F.abs(F.col("total_forecast") - HORIZON * F.col("forecast_avg")) <= 1e-9 * F.col("total_forecast")).alias("total_agrees"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources
    "load_sales": load_sales,
    "product_categories": product_category_map,
    "snapshot_roundtrip": snapshot_roundtrip,
    "export_roundtrip": export_roundtrip,
    "incremental_refresh": incremental_refresh,
    "refresh_by_header": refresh_by_header,
    "refresh_corrections": refresh_corrections,
    "snapshot_compaction": snapshot_compaction,
    "date_layouts": date_layouts,
    "rollup_reports": rollup_reports,
    "rollup_growth": rollup_growth,
    "rollup_profile": rollup_profile,
    # J1
    "sales_by_category": _on_sales(sales_by_category),
    # filters
    **{name: _filtered(flt) for name, flt in FILTERS.items()},
    # KPIs
    "kpis": _on_sales(K.kpis),
    "growth": _rolled(RU.growth, K.growth),
    "data_profile": _rolled(lambda r, s: RU.data_profile(r, s.columns), K.data_profile),
    "filter_values": _rolled(lambda r, s: RU.filter_values(r), K.filter_values),
    # revenue
    "monthly_revenue": _rolled(lambda r, s: RU.monthly_revenue(r), R.monthly_revenue),
    "revenue_by_type": _rolled(lambda r, s: RU.revenue_by_type(r), R.revenue_by_type),
    "quarterly_revenue": _rolled(lambda r, s: RU.quarterly_revenue(r), R.quarterly_revenue),
    "revenue_by_status": _rolled(lambda r, s: RU.revenue_by_status(r), R.revenue_by_status),
    # customers
    "customer_value": _on_sales(R.customer_value),
    "top_customers_15": _on_sales(lambda s: R.top_customers(s, 15)),
    "top_customers_50": _on_sales(lambda s: R.top_customers(s, 50)),
    "recency_histogram": _on_sales(R.recency_histogram),
    "nice_recency_histogram": _on_sales(R.nice_recency_histogram),
    # products
    "top_products": _rolled(lambda r, s: RU.top_products(r), R.top_products),
    "item_type_counts": _rolled(lambda r, s: RU.item_type_counts(r), R.item_type_counts),
    "product_table": _rolled(lambda r, s: RU.product_table(r), R.product_table),
    # colours
    "colour_revenue": _rolled(lambda r, s: RU.colour_revenue(r), R.colour_revenue),
    "colour_units": _rolled(lambda r, s: RU.colour_units(r), R.colour_units),
    "multi_colour_products": _on_sales(R.multi_colour_products),
    "colour_breakdown": _on_sales(R.colour_breakdown),
    "colour_breakdown_all": _on_sales(R.colour_breakdown_all),
    "colour_summary": _on_sales(R.colour_summary),
    # geographic
    "top_towns": _rolled(lambda r, s: RU.top_towns(r), R.top_towns),
    "revenue_by_payment": _rolled(lambda r, s: RU.revenue_by_payment(r), R.revenue_by_payment),
    # series
    "top_demand_products": _on_sales(lambda s: S.top_demand_products(s, TOP_N)),
    "demand_monthly": _on_sales(lambda s: _series_out(S.demand_series(s, TOP_N))),
    "month_features": _on_sales(
        lambda s: _long(S.month_features(S.revenue_series(s)), "months_since_start")),
    "demand_features": _on_sales(
        lambda s: _long(S.demand_features(S.demand_series(s, TOP_N)), "months_since_start")),
    "train_test_split": _on_sales(lambda s: S.train_test_split(S.revenue_series(s))),
    "trend_direction": _on_sales(lambda s: S.trend_direction(S.revenue_series(s))),
    "seasonal_index": _on_sales(lambda s: FL.seasonal_index(S.revenue_series(s))),
    # linear forecasts
    "revenue_forecast_linear": _on_sales(_revenue_forecast),
    "linear_fit_metrics": _on_sales(lambda s: FL.revenue_fit_metrics(S.revenue_series(s))),
    "forecast_table": _on_sales(lambda s: FL.forecast_table(_revenue_forecast(s))),
    "forecast_totals": _on_sales(lambda s: FL.forecast_totals(_revenue_forecast(s))),
    "demand_forecast_linear": _on_sales(_demand_forecast),
    "demand_summary": _on_sales(_demand_summary),
    "linear_feature_importance": _on_sales(
        lambda s: FL.linear_feature_importance(S.revenue_series(s))),
    # boosted trees (MLlib; rows-only check)
    "revenue_forecast_gbt": _on_sales(lambda s: FG.revenue_forecast(S.revenue_series(s), HORIZON)),
    "gbt_fit_metrics": _on_sales(lambda s: FG.gbt_fit_metrics(S.revenue_series(s))),
    "feature_importance": _on_sales(lambda s: FG.feature_importance(S.revenue_series(s))),
    "demand_forecast_gbt": _on_sales(_demand_gbt),
    "forecast_table_gbt": _on_sales(
        lambda s: FL.forecast_table(FG.revenue_forecast(S.revenue_series(s), HORIZON))),
    "forecast_totals_gbt": _on_sales(
        lambda s: FL.forecast_totals(FG.revenue_forecast(S.revenue_series(s), HORIZON))),
    "demand_summary_gbt": _on_sales(_demand_summary_gbt),
    # the same fits, by what has a known answer
    "revenue_forecast_gbt_checks": _on_sales(
        lambda s: FG.revenue_forecast_checks(S.revenue_series(s), HORIZON)),
    "gbt_fit_checks": _on_sales(lambda s: FG.fit_checks(S.revenue_series(s))),
    "feature_importance_checks": _on_sales(lambda s: FG.importance_checks(S.revenue_series(s))),
    "demand_forecast_gbt_checks": _on_sales(_demand_gbt_checks),
    "forecast_table_gbt_checks": _on_sales(_table_gbt_checks),
    "forecast_totals_gbt_checks": _on_sales(_totals_gbt_checks),
    "demand_summary_gbt_checks": _on_sales(_summary_gbt_checks),
}
