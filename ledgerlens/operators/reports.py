"""Grouped reports and top-k lists.

Each report is ``DataFrame -> DataFrame`` over the (filtered) sales table.
Money is summed exactly as decimal and cast to double only in the output.
Every group-by drops null keys, as the source's group-bys do. Ties in a
ranking are broken by the key ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as LF
from ..schema import MONEY
from .filters import has_colour
from .joins import attach_scalar_row


def with_optional(sales: DataFrame, *cols: str) -> DataFrame:
    """Absent optional text columns as typed nulls.

    The source skips a report whose column is missing; here the column reads
    as null, null keys are dropped, and the report comes back empty with its
    usual schema.
    """
    missing = {c: F.lit(None).cast("string") for c in cols if c not in sales.columns}
    return sales.withColumns(missing) if missing else sales


def with_report_columns(sales: DataFrame) -> DataFrame:
    """Absent date, amount or quantity columns as typed nulls: their reports come back empty
    (or zero), as the source skips them."""
    kinds = {"invoice_date": "timestamp", "total_price": MONEY, "qty": "double"}
    missing = {c: F.lit(None).cast(k) for c, k in kinds.items() if c not in sales.columns}
    return sales.withColumns(missing) if missing else sales


def _revenue_by(sales: DataFrame, key: str, out_key: str | None = None,
                measure: str = "total_price", out_measure: str = "total_price") -> DataFrame:
    out_key = out_key or key
    sales = with_optional(sales, key)
    return (sales.where(F.col(key).isNotNull())
            .groupBy(F.col(key).alias(out_key))
            .agg(F.sum(measure).alias(out_measure)))


def _money(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: LF.money_out(c) for c in cols})


def top_k(df: DataFrame, order_col: str, key: str, k: int) -> DataFrame:
    """K1-K4: largest ``k`` by ``order_col``; ties by key ascending (TakeOrderedAndProject)."""
    return df.orderBy(F.col(order_col).desc(), F.col(key).asc()).limit(k)


# --- revenue tab ------------------------------------------------------------

def monthly_revenue(sales: DataFrame) -> DataFrame:
    """A3: revenue per ``YYYY-MM``, ascending; undated lines dropped.

    Lines are grouped by the truncated date; only the result rows are formatted."""
    return _revenue_by_period(sales, "month", LF.month_label)


def _revenue_by_period(sales: DataFrame, period: str, label) -> DataFrame:
    m = (with_report_columns(sales).where(F.col("invoice_date").isNotNull())
         .groupBy(F.date_trunc(period, F.col("invoice_date")).alias("_start"))
         .agg(F.sum("total_price").alias("total_price")))
    return _money(m.select(label("_start").alias(period), "total_price"), "total_price").orderBy(period)


def revenue_by_type(sales: DataFrame) -> DataFrame:
    """A4: revenue per customer type, descending."""
    r = _revenue_by(sales, "type")
    return _money(r.orderBy(F.col("total_price").desc(), F.col("type")), "total_price")


def quarterly_revenue(sales: DataFrame) -> DataFrame:
    """A5: revenue per ``YYYYQn``, ascending."""
    return _revenue_by_period(sales, "quarter", LF.quarter_label)


def revenue_by_status(sales: DataFrame) -> DataFrame:
    """Revenue per order status, key ascending."""
    return _money(_revenue_by(sales, "status"), "total_price").orderBy("status")


def revenue_by_payment(sales: DataFrame) -> DataFrame:
    """Revenue per payment method, key ascending."""
    return _money(_revenue_by(sales, "payment_method"), "total_price").orderBy("payment_method")


# --- customers tab ----------------------------------------------------------

def customer_value(sales: DataFrame) -> DataFrame:
    """Per customer - days since last purchase, distinct invoices, revenue.

    Lines without customer or date are dropped. Recency is whole days from
    the customer's last invoice to the latest invoice of all kept lines. That
    anchor is a global max over the lines (a two-column scan, one row per
    task, no shuffle), broadcast as one row. The distinct-invoice count is
    planned as a (customer, invoice) de-duplication first, which spreads a
    customer with very many lines over all partitions.
    """
    kept = with_optional(sales, "company").where(
        F.col("company").isNotNull() & F.col("invoice_date").isNotNull())
    per = (kept.groupBy(F.col("company").alias("customer"))
           .agg(F.max("invoice_date").alias("_last"),
                F.count_distinct("invoice_no").alias("order_count"),
                F.sum("total_price").alias("total_revenue")))
    anchor = kept.agg(F.max("invoice_date").alias("_anchor"))
    x = attach_scalar_row(per, anchor)
    return x.select(
        "customer",
        LF.whole_days_between("_anchor", "_last").alias("days_since_last_purchase"),
        "order_count",
        "total_revenue",
    )


def top_customers(sales: DataFrame, k: int = 15) -> DataFrame:
    """K1: top ``k`` customers by revenue."""
    return _money(top_k(customer_value(sales), "total_revenue", "customer", k), "total_revenue")


RECENCY_BINS = 25


def recency_histogram(sales: DataFrame, bins: int = RECENCY_BINS) -> DataFrame:
    """Customers per recency bin; at most ``bins`` equal-width integer bins.

    width = ceil((max - min + 1) / bins); bin = floor((days - min) / width).
    """
    # one number per customer, checkpointed so the span and the binning read it
    # once instead of re-aggregating the lines twice
    cv = customer_value(sales).select("days_since_last_purchase").checkpoint(eager=True)
    span = cv.agg(F.min("days_since_last_purchase").alias("_lo"),
                  F.max("days_since_last_purchase").alias("_hi"))
    span = span.select("_lo", F.greatest(F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.lit(bins)),
                                         F.lit(1)).cast("long").alias("_w"))
    x = attach_scalar_row(cv, span)
    b = F.floor((F.col("days_since_last_purchase") - F.col("_lo")) / F.col("_w")).cast("long")
    h = (x.groupBy(b.alias("bin"), "_lo", "_w").agg(F.count(F.lit(1)).alias("customers")))
    return h.select(
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_end"),
        "customers",
    ).orderBy("bin")


def nice_width(lo: Column, hi: Column, bins: int) -> Column:
    """The smallest width of the ladder 1, 2, 5, 10, 20, 50, ... whose multiples cut whole numbers
    from ``lo`` to ``hi`` into at most ``bins`` bins."""
    ladder = F.array(*[F.lit(m * 10 ** k).cast("long") for k in range(18) for m in (1, 2, 5)])
    few = F.filter(ladder, lambda w: F.floor(hi / w) - F.floor(lo / w) + 1 <= bins)
    return F.try_element_at(few, F.lit(1))


def nice_recency_histogram(sales: DataFrame, bins: int = RECENCY_BINS) -> DataFrame:
    """A8 with the edges a chart picks: multiples of a width of the 1-2-5 ladder, at most ``bins`` bins."""
    cv = customer_value(sales).select("days_since_last_purchase").checkpoint(eager=True)
    days = F.col("days_since_last_purchase")
    width = cv.agg(nice_width(F.min(days), F.max(days), bins).alias("_w"))
    x = attach_scalar_row(cv, width)
    start = (F.floor(days / F.col("_w")) * F.col("_w")).cast("long")
    return (x.groupBy(start.alias("bin_start"), (start + F.col("_w")).alias("bin_end"))
            .agg(F.count(F.lit(1)).alias("customers")).orderBy("bin_start"))


# --- products tab -----------------------------------------------------------

def product_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per product (null product dropped)."""
    return _revenue_by(sales, "short_description", "product")


def top_products(sales: DataFrame, k: int = 10) -> DataFrame:
    """K2: top ``k`` products by revenue."""
    return _money(top_k(product_revenue(sales), "total_price", "product", k), "total_price")


def item_type_counts(sales: DataFrame) -> DataFrame:
    """A10: lines per item type, descending."""
    c = (with_optional(sales, "item_type").where(F.col("item_type").isNotNull())
         .groupBy("item_type").agg(F.count(F.lit(1)).alias("count")))
    return c.orderBy(F.col("count").desc(), F.col("item_type"))


def product_table(sales: DataFrame, k: int = 20) -> DataFrame:
    """A11 + K2: top ``k`` products with revenue, units and a currency label."""
    t = (with_optional(sales, "short_description").where(F.col("short_description").isNotNull())
         .groupBy(F.col("short_description").alias("product"))
         .agg(F.sum("total_price").alias("revenue"), LF.exact_total("qty").alias("units_sold")))
    t = top_k(t, "revenue", "product", k)
    return t.select("product", LF.money_out("revenue").alias("revenue"), "units_sold",
                    LF.currency_label("revenue").alias("revenue_label"))


# --- colours tab ------------------------------------------------------------

def colour_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per colour, descending."""
    r = _revenue_by(has_colour(sales), "colour")
    return _money(r.orderBy(F.col("total_price").desc(), F.col("colour")), "total_price")


def colour_units(sales: DataFrame) -> DataFrame:
    """Units per colour, descending."""
    u = (has_colour(sales).groupBy("colour").agg(LF.exact_total("qty").alias("qty")))
    return u.orderBy(F.col("qty").desc(), F.col("colour"))


def multi_colour_products(sales: DataFrame) -> DataFrame:
    """A14 + F11: products sold in more than one colour, sorted."""
    c = (has_colour(sales).where(F.col("short_description").isNotNull())
         .groupBy(F.col("short_description").alias("product"))
         .agg(F.count_distinct("colour").alias("colours")))
    return c.where(F.col("colours") > 1).orderBy("product")


def _colour_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    # an order counts at its first line in a group: a sort holds the lines' few columns once, where
    # a distinct count keeps a table of all (group, order) pairs with their sums on both sides of a shuffle
    lines = df.select(*keys, "invoice_no", "total_price", "qty")
    first = F.row_number().over(Window.partitionBy("invoice_no", *keys).orderBy(F.lit(0))) == 1
    g = lines.withColumn("_first", first & F.col("invoice_no").isNotNull()).groupBy(*keys).agg(
        F.sum("total_price").alias("_revenue"),
        LF.exact_total("qty").alias("units_sold"),
        F.count_if("_first").alias("orders"))
    return g.select(
        *keys,
        LF.money_out("_revenue").alias("revenue"),
        "units_sold",
        "orders",
        LF.ratio_2dp("_revenue", "units_sold").alias("avg_price_per_unit"),
        LF.currency_label("_revenue").alias("revenue_label"),
        LF.currency_label(LF.ratio_2dp("_revenue", "units_sold"), 2).alias("avg_price_label"),
    )


def colour_breakdown_all(sales: DataFrame) -> DataFrame:
    """A15/A16 for every multi-colour product at once: (product, colour) rows.

    Lines are aggregated per (product, colour) first; a product is kept when
    it has more than one colour group, counted with a window over that small
    aggregate (a product has at most one row per colour), so the line table
    is never joined. The source's per-product table is a filter of this one.
    """
    coloured = has_colour(sales).where(F.col("short_description").isNotNull())
    stats = _colour_stats(coloured.withColumn("product", F.col("short_description")), ["product", "colour"])
    n_colours = F.count(F.lit(1)).over(Window.partitionBy("product"))
    return stats.withColumn("_colours", n_colours).where(F.col("_colours") > 1).drop("_colours")


def colour_breakdown(sales: DataFrame, product: str | None = None) -> DataFrame:
    """Colour table for one product (default: the first multi-colour product)."""
    if product is None:  # a scalar subquery: only that product's lines are aggregated
        chosen = multi_colour_products(sales).agg(F.min("product")).scalar()
    else:
        chosen = F.lit(product)
    out = _colour_stats(has_colour(sales).where(F.col("short_description") == chosen), ["colour"])
    return out.orderBy(F.col("revenue").desc(), F.col("colour"))


def colour_summary(sales: DataFrame) -> DataFrame:
    """Per colour - revenue, units, distinct invoices, distinct products."""
    g = has_colour(sales).groupBy("colour").agg(
        F.sum("total_price").alias("_revenue"),
        LF.exact_total("qty").alias("units_sold"),
        F.count_distinct("invoice_no").alias("orders"),
        F.count_distinct("short_description").alias("products"))
    return g.select(
        "colour", LF.money_out("_revenue").alias("revenue"), "units_sold", "orders", "products",
        LF.currency_label("_revenue").alias("revenue_label"),
    ).orderBy(F.col("revenue").desc(), F.col("colour"))


# --- geographic tab ---------------------------------------------------------

def town_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per delivery town."""
    return _revenue_by(sales, "delivery_town")


def top_towns(sales: DataFrame, k: int = 15) -> DataFrame:
    """K3: top ``k`` towns by revenue."""
    return _money(top_k(town_revenue(sales), "total_price", "delivery_town", k), "total_price")
