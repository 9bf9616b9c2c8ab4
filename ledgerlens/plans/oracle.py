"""DuckDB twins of the registered queries (independent SQL, same semantics).

Each string runs on the pre-registered views (lineitem, orders, ...). The
shared prefix rebuilds the cleaned, category-enriched sales table in SQL;
every query then states its own report. Money is summed as DECIMAL and cast
to DOUBLE in the output, exactly like the Spark side.
"""

from __future__ import annotations

from ..functions import STRIPPED
from ..operators.rollups import DIMENSIONS
from ..sources.fixtures import PRODUCT_CODES_SQL, SALES_RAW_SQL, SALES_SQL
from .catalog import (CATEGORIES, DATE_RANGE, FURNITURE_GROUPS, ITEM_TYPES, STATUSES,
                      TYPES)

# Unicode white space, stripped from both ends of a flag
_STRIPPED = "".join(f" || chr({ord(c)})" for c in STRIPPED)[4:]
_CATS = f"""
codes AS ({PRODUCT_CODES_SQL}),
cats AS (
  SELECT description, min(category) AS category
  FROM (SELECT description,
               CASE upper(trim(landscape_or_furniture, {_STRIPPED})) WHEN 'F' THEN 'Furniture'
                                                          WHEN 'L' THEN 'Landscape' END AS category
        FROM codes)
  WHERE description IS NOT NULL AND category IS NOT NULL
  GROUP BY description)"""

_DERIVED = """CAST(year(invoice_date) AS INTEGER) AS year,
  CAST(month(invoice_date) AS INTEGER) AS month,
  CAST(quarter(invoice_date) AS INTEGER) AS quarter,
  strftime(invoice_date, '%Y-%m') AS year_month"""

PREFIX = f"""WITH sales_base AS ({SALES_SQL}),
{_CATS},
sales AS (
  SELECT b.*, {_DERIVED}, c.category AS product_category
  FROM sales_base b LEFT JOIN cats c ON b.short_description = c.description)
"""

# the same table after the corrections of ``catalog.refresh_corrections``
CORRECTED_PREFIX = PREFIX.replace("sales AS (", "given AS (", 1).rstrip() + """,
sales AS (
  SELECT * EXCLUDE (copy) REPLACE (CASE WHEN invoice_no % 3 = 1 AND invoice_no % 10 = 2 THEN qty + 1 ELSE qty END AS qty)
  FROM (SELECT *, unnest(range(CASE WHEN invoice_no % 3 <> 1 THEN 1 WHEN invoice_no % 10 = 1 THEN 0
                                    WHEN invoice_no % 10 = 3 THEN 2 ELSE 1 END)) AS copy FROM given))
"""

MONEY_AS_DOUBLE = ("* REPLACE (CAST(price AS DOUBLE) AS price, CAST(discount AS DOUBLE) AS discount, "
                   "CAST(total_price AS DOUBLE) AS total_price)")
# row-level results: money and the (nullable) calendar parts as DOUBLE
ROW_OUT = ("* REPLACE (CAST(price AS DOUBLE) AS price, CAST(discount AS DOUBLE) AS discount, "
           "CAST(total_price AS DOUBLE) AS total_price, CAST(year AS DOUBLE) AS year, "
           "CAST(month AS DOUBLE) AS month, CAST(quarter AS DOUBLE) AS quarter)")
_DERIVED_ROW = """CAST(year(invoice_date) AS DOUBLE) AS year,
  CAST(month(invoice_date) AS DOUBLE) AS month,
  CAST(quarter(invoice_date) AS DOUBLE) AS quarter,
  strftime(invoice_date, '%Y-%m') AS year_month"""


def _q(body: str) -> str:
    return PREFIX + body


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _keep(col: str, values) -> str:
    return f"({col} IN {_in(values)} OR {col} IS NULL)"


_DATE = (f"(CAST(invoice_date AS DATE) BETWEEN DATE '{DATE_RANGE[0]}' "
         f"AND DATE '{DATE_RANGE[1]}')")

FILTER_SQL = {
    "filter_date": _DATE,
    "filter_type": _keep("type", TYPES),
    "filter_status": _keep("status", STATUSES),
    "filter_category": _keep("product_category", CATEGORIES),
    "filter_item_type": _keep("item_type", ITEM_TYPES),
    "filter_furniture_group": _keep("furniture_group", FURNITURE_GROUPS),
    "filter_combined": f"{_DATE} AND {_keep('type', TYPES)} AND {_keep('status', STATUSES)}",
}

_LOAD_SALES = f"""WITH raw AS ({SALES_RAW_SQL}),
typed AS (
  SELECT invoice_no,
    TRY_CAST(invoice_date AS TIMESTAMP) AS invoice_date,
    TRY_CAST(order_date AS TIMESTAMP) AS order_date,
    TRY_CAST(dispatch_date AS TIMESTAMP) AS dispatch_date,
    TRY_CAST(completed_date AS TIMESTAMP) AS completed_date,
    company, type, status, item_type, short_description,
    coalesce(TRY_CAST(trim(qty) AS DOUBLE), 0) AS qty,
    coalesce(TRY_CAST(trim(price) AS DECIMAL(30,6)), 0) AS price,
    coalesce(TRY_CAST(trim(discount) AS DECIMAL(30,6)), 0) AS discount,
    coalesce(TRY_CAST(trim(total_price) AS DECIMAL(30,6)), 0) AS total_price,
    coalesce(TRY_CAST(trim(weight_kg) AS DOUBLE), 0) AS weight_kg,
    delivery_town, payment_method, production_status, furniture_group, colour
  FROM raw)
SELECT {MONEY_AS_DOUBLE}, {_DERIVED_ROW} FROM typed"""

_CUSTOMER_VALUE = """customer_value AS (
  SELECT customer,
         CAST(floor((epoch_us(max(_last) OVER ()) - epoch_us(_last)) / 86400000000.0) AS BIGINT)
           AS days_since_last_purchase,
         order_count, total_revenue
  FROM (SELECT company AS customer, max(invoice_date) AS _last,
               count(DISTINCT invoice_no) AS order_count, sum(total_price) AS total_revenue
        FROM sales WHERE company IS NOT NULL AND invoice_date IS NOT NULL
        GROUP BY company))
"""


def _top_customers(k: int) -> str:
    return _q(f""", {_CUSTOMER_VALUE}
SELECT customer, days_since_last_purchase, order_count, CAST(total_revenue AS DOUBLE) AS total_revenue
FROM customer_value ORDER BY total_revenue DESC, customer ASC LIMIT {k}""")


def _growth_cols() -> str:
    parts = []
    for name, n in [("30_day", 30), ("90_day", 90), ("yoy", 365)]:
        cur = f"coalesce(sum(CASE WHEN invoice_date >= anchor - INTERVAL {n} DAY THEN amount END), 0)"
        prev = (f"coalesce(sum(CASE WHEN invoice_date >= anchor - INTERVAL {2 * n} DAY "
                f"AND invoice_date < anchor - INTERVAL {n} DAY THEN amount END), 0)")
        parts.append(f"{cur} AS _{name}_cur, {prev} AS _{name}_prev")
    return ",\n  ".join(parts)


def _growth_pct(name: str) -> str:
    c, p = f"CAST(_{name}_cur AS DOUBLE)", f"CAST(_{name}_prev AS DOUBLE)"
    return f"CASE WHEN {p} > 0 THEN ({c} - {p}) / {p} * 100.0 ELSE 0.0 END AS growth_{name}"


def _signed(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN '+' ELSE '' END || replace(format('{{:,.1f}}', {x}), ',', '') || '%'"


_PROFILE_COLS = [
    "invoice_no", "invoice_date", "order_date", "dispatch_date", "completed_date",
    "company", "type", "status", "item_type", "short_description", "qty", "price",
    "discount", "total_price", "weight_kg", "delivery_town", "payment_method",
    "production_status", "furniture_group", "colour", "year", "month", "quarter",
    "year_month", "product_category"]

_FILTER_VALUE_COLS = ["type", "status", "product_category", "item_type", "furniture_group", "colour"]

_COLOUR_STATS = """CAST(sum(total_price) AS DOUBLE) AS revenue,
  CAST(sum(CAST(qty AS DECIMAL(30,6))) AS DOUBLE) AS units_sold,
  count(DISTINCT invoice_no) AS orders,
  round_even(CAST(sum(total_price) AS DOUBLE) / nullif(CAST(sum(CAST(qty AS DECIMAL(30,6))) AS DOUBLE), 0), 2) AS avg_price_per_unit,
  '£' || format('{:,.0f}', CAST(sum(total_price) AS DOUBLE)) AS revenue_label,
  '£' || format('{:,.2f}', round_even(CAST(sum(total_price) AS DOUBLE) / nullif(CAST(sum(CAST(qty AS DECIMAL(30,6))) AS DOUBLE), 0), 2))
    AS avg_price_label"""

_MULTI = """multi AS (
  SELECT short_description AS product, count(DISTINCT colour) AS colours
  FROM sales WHERE colour IS NOT NULL AND colour <> '' AND short_description IS NOT NULL
  GROUP BY short_description HAVING count(DISTINCT colour) > 1)
"""

ORACLE: dict[str, str] = {
    "load_sales": _LOAD_SALES,
    "product_categories": f"WITH {_CATS.strip()}\nSELECT description, category FROM cats",
    "snapshot_roundtrip": _q(f"SELECT {ROW_OUT} FROM sales"),
    "export_roundtrip": f"""WITH s0 AS ({SALES_SQL}),
s AS (SELECT * REPLACE (CASE invoice_no % 11
  WHEN 0 THEN company || chr(10) || 'second line' WHEN 1 THEN '"' || company || '", x'
  WHEN 2 THEN chr(92) || company || chr(92) WHEN 3 THEN '  ' || company || ' ' WHEN 4 THEN chr(92) || 'N'
  WHEN 5 THEN '' WHEN 6 THEN chr(92) || chr(92) || 'N' ELSE company END AS company) FROM s0)
SELECT * REPLACE (CAST(invoice_no AS VARCHAR) AS invoice_no, CAST(price AS DOUBLE) AS price,
                  CAST(discount AS DOUBLE) AS discount, CAST(total_price AS DOUBLE) AS total_price),
  {_DERIVED_ROW}
FROM s""",
    "incremental_refresh": _q(f"SELECT {ROW_OUT} FROM sales"),
    # exports are text: without a base, invoice numbers stay text
    "refresh_by_header": _q(f"""SELECT * REPLACE (CAST(invoice_no AS VARCHAR) AS invoice_no,
  CASE WHEN invoice_no % 3 = 1 THEN NULL ELSE colour END AS colour) FROM (SELECT {ROW_OUT} FROM sales)"""),
    "refresh_corrections": f"{CORRECTED_PREFIX}SELECT {ROW_OUT} FROM sales",
    "date_layouts": "SELECT written, layout, n AS lines, n AS equal FROM (SELECT count(*) AS n FROM orders), (VALUES "
                    "('iso', 'yyyy-M-d'), ('day_first', 'd/M/yyyy'), ('month_name', 'd MMM yyyy'), ('compact', 'yyyyMMdd'), "
                    "('stamped', 'M/d/yyyy h:mm a')) t(written, layout)",
    "rollup_reports": CORRECTED_PREFIX + " UNION ALL ".join(f"""SELECT '{d}' AS dimension, {v} AS value, strftime(invoice_date, '%Y-%m') AS month,
  count(*) AS lines, CAST(sum(total_price) AS DOUBLE) AS revenue, sum(qty) AS units FROM sales GROUP BY 2, 3""" for d, v in [
        ("line", "CAST(NULL AS VARCHAR)"), *((d, d) for d in DIMENSIONS)]),
    "snapshot_compaction": _q(f"SELECT {ROW_OUT}, true AS merged FROM sales"),
    "sales_by_category": _q("""SELECT product_category, count(*) AS lines,
  CAST(sum(total_price) AS DOUBLE) AS revenue FROM sales GROUP BY product_category"""),
    **{name: _q(f"SELECT {ROW_OUT} FROM sales WHERE {cond}")
       for name, cond in FILTER_SQL.items()},
    "kpis": _q(""", k AS (SELECT
  CAST(coalesce(sum(total_price), 0) AS DOUBLE) AS total_revenue,
  CASE WHEN count(*) > 0 THEN CAST(coalesce(sum(total_price), 0) AS DOUBLE) / count(*) ELSE 0.0 END
    AS avg_transaction,
  count(DISTINCT invoice_no) + coalesce(max(CASE WHEN invoice_no IS NULL THEN 1 ELSE 0 END), 0)
    AS total_orders,
  CASE WHEN count(DISTINCT invoice_no) + coalesce(max(CASE WHEN invoice_no IS NULL THEN 1 ELSE 0 END), 0) > 0
       THEN CAST(coalesce(sum(total_price), 0) AS DOUBLE)
            / (count(DISTINCT invoice_no) + coalesce(max(CASE WHEN invoice_no IS NULL THEN 1 ELSE 0 END), 0))
       ELSE 0.0 END AS aov,
  count(DISTINCT company) + coalesce(max(CASE WHEN company IS NULL THEN 1 ELSE 0 END), 0)
    AS total_customers,
  CASE WHEN count(DISTINCT company) + coalesce(max(CASE WHEN company IS NULL THEN 1 ELSE 0 END), 0) > 0
       THEN CAST(coalesce(sum(total_price), 0) AS DOUBLE)
            / (count(DISTINCT company) + coalesce(max(CASE WHEN company IS NULL THEN 1 ELSE 0 END), 0))
       ELSE 0.0 END AS revenue_per_customer,
  coalesce(CAST(sum(CAST(qty AS DECIMAL(30,6))) AS DOUBLE), 0.0) AS total_units,
  CASE WHEN count(*) > 0 THEN coalesce(CAST(sum(CAST(qty AS DECIMAL(30,6))) AS DOUBLE), 0.0) / count(*) ELSE 0.0 END AS avg_basket_size
FROM sales)
SELECT *, '£' || format('{:,.0f}', total_revenue) AS total_revenue_label,
  format('{:,}', total_orders) AS total_orders_label, '£' || format('{:,.0f}', aov) AS aov_label,
  format('{:,}', total_customers) AS total_customers_label, format('{:,.0f}', total_units) AS total_units_label,
  '£' || format('{:,.0f}', revenue_per_customer) AS revenue_per_customer_label
FROM k"""),
    "growth": _q(f""", per_ts AS (
  SELECT invoice_date, sum(total_price) AS amount FROM sales
  WHERE invoice_date IS NOT NULL GROUP BY invoice_date),
x AS (SELECT *, max(invoice_date) OVER () AS anchor FROM per_ts),
g AS (SELECT anchor,
  {_growth_cols()}
  FROM x GROUP BY anchor),
p AS (SELECT {_growth_pct('30_day')}, {_growth_pct('90_day')}, {_growth_pct('yoy')},
  CAST(_30_day_cur AS DOUBLE) AS current_30_day, CAST(_30_day_prev AS DOUBLE) AS previous_30_day,
  anchor AS anchor_date
FROM g)
SELECT *, {_signed('growth_30_day')} AS growth_30_day_label, {_signed('growth_90_day')} AS growth_90_day_label,
  {_signed('growth_yoy')} AS growth_yoy_label
FROM p"""),
    "data_profile": _q(""", prof AS (SELECT count(*) AS row_count,
  """ + " + ".join(f"(count(*) - count({c}))" for c in _PROFILE_COLS) + """ AS nulls,
  min(invoice_date) AS mn, max(invoice_date) AS mx FROM sales)
SELECT row_count, CAST(25 AS BIGINT) AS column_count, '' AS missing_columns,
  CASE WHEN row_count * 25 > 0 THEN (1.0 - nulls / (row_count * 25)) * 100.0 END AS completeness_pct,
  strftime(mn, '%Y-%m-%d') AS min_date, strftime(mx, '%Y-%m-%d') AS max_date
FROM prof"""),
    "filter_values": _q("SELECT DISTINCT filter_column, value FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS filter_column, CAST({c} AS VARCHAR) AS value FROM sales"
        for c in _FILTER_VALUE_COLS) + ") WHERE value IS NOT NULL ORDER BY filter_column, value"),
    "monthly_revenue": _q("""SELECT strftime(invoice_date, '%Y-%m') AS month,
  CAST(sum(total_price) AS DOUBLE) AS total_price
FROM sales WHERE invoice_date IS NOT NULL GROUP BY 1 ORDER BY 1"""),
    "revenue_by_type": _q("""SELECT type, CAST(sum(total_price) AS DOUBLE) AS total_price
FROM sales WHERE type IS NOT NULL GROUP BY type ORDER BY 2 DESC, 1"""),
    "quarterly_revenue": _q("""SELECT CAST(year(invoice_date) AS VARCHAR) || 'Q' || CAST(quarter(invoice_date) AS VARCHAR)
  AS quarter, CAST(sum(total_price) AS DOUBLE) AS total_price
FROM sales WHERE invoice_date IS NOT NULL GROUP BY 1 ORDER BY 1"""),
    "revenue_by_status": _q("""SELECT status, CAST(sum(total_price) AS DOUBLE) AS total_price
FROM sales WHERE status IS NOT NULL GROUP BY status ORDER BY 1"""),
    "customer_value": _q(f""", {_CUSTOMER_VALUE}
SELECT customer, days_since_last_purchase, order_count, CAST(total_revenue AS DOUBLE) AS total_revenue
FROM customer_value"""),
    "top_customers_15": _top_customers(15),
    "top_customers_50": _top_customers(50),
    "recency_histogram": _q(f""", {_CUSTOMER_VALUE},
span AS (SELECT min(days_since_last_purchase) AS lo,
  greatest(CAST(ceil((max(days_since_last_purchase) - min(days_since_last_purchase) + 1) / 25.0) AS BIGINT), 1) AS w
  FROM customer_value),
b AS (SELECT CAST(floor((days_since_last_purchase - lo) / w) AS BIGINT) AS bin, lo, w
      FROM customer_value, span)
SELECT bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, count(*) AS customers
FROM b GROUP BY bin, lo, w ORDER BY bin"""),
    "nice_recency_histogram": _q(f""", {_CUSTOMER_VALUE},
ladder AS (SELECT CAST(m * 10 ** k AS BIGINT) AS w FROM range(18) k(k), (VALUES (1), (2), (5)) m(m)),
width AS (
  SELECT min(w) AS w FROM ladder, (SELECT min(days_since_last_purchase) AS lo, max(days_since_last_purchase) AS hi FROM customer_value)
  WHERE hi // w - lo // w + 1 <= 25)
SELECT days_since_last_purchase // w * w AS bin_start, days_since_last_purchase // w * w + w AS bin_end, count(*) AS customers
FROM customer_value, width GROUP BY 1, 2 ORDER BY 1"""),
    "top_products": _q("""SELECT short_description AS product, CAST(sum(total_price) AS DOUBLE) AS total_price
FROM sales WHERE short_description IS NOT NULL GROUP BY 1
ORDER BY sum(total_price) DESC, product ASC LIMIT 10"""),
    "item_type_counts": _q("""SELECT item_type, count(*) AS count FROM sales
WHERE item_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1"""),
    "product_table": _q("""SELECT product, CAST(revenue AS DOUBLE) AS revenue, units_sold,
  '£' || format('{:,.0f}', CAST(revenue AS DOUBLE)) AS revenue_label
FROM (SELECT short_description AS product, sum(total_price) AS revenue, CAST(sum(CAST(qty AS DECIMAL(30,6))) AS DOUBLE) AS units_sold
      FROM sales WHERE short_description IS NOT NULL GROUP BY 1
      ORDER BY revenue DESC, product ASC LIMIT 20)"""),
    "colour_revenue": _q("""SELECT colour, CAST(sum(total_price) AS DOUBLE) AS total_price
FROM sales WHERE colour IS NOT NULL AND colour <> '' GROUP BY 1 ORDER BY 2 DESC, 1"""),
    "colour_units": _q("""SELECT colour, CAST(sum(CAST(qty AS DECIMAL(30,6))) AS DOUBLE) AS qty
FROM sales WHERE colour IS NOT NULL AND colour <> '' GROUP BY 1 ORDER BY 2 DESC, 1"""),
    "multi_colour_products": _q(f", {_MULTI}SELECT product, colours FROM multi ORDER BY product"),
    "colour_breakdown": _q(f""", {_MULTI}
SELECT colour, {_COLOUR_STATS}
FROM sales WHERE colour IS NOT NULL AND colour <> ''
  AND short_description = (SELECT min(product) FROM multi)
GROUP BY colour ORDER BY revenue DESC, colour"""),
    "colour_breakdown_all": _q(f""", {_MULTI}
SELECT short_description AS product, colour, {_COLOUR_STATS}
FROM sales WHERE colour IS NOT NULL AND colour <> ''
  AND short_description IN (SELECT product FROM multi)
GROUP BY short_description, colour"""),
    "colour_summary": _q("""SELECT colour, CAST(sum(total_price) AS DOUBLE) AS revenue, CAST(sum(CAST(qty AS DECIMAL(30,6))) AS DOUBLE) AS units_sold,
  count(DISTINCT invoice_no) AS orders, count(DISTINCT short_description) AS products,
  '£' || format('{:,.0f}', CAST(sum(total_price) AS DOUBLE)) AS revenue_label
FROM sales WHERE colour IS NOT NULL AND colour <> '' GROUP BY colour ORDER BY revenue DESC, colour"""),
    "top_towns": _q("""SELECT delivery_town, CAST(sum(total_price) AS DOUBLE) AS total_price
FROM sales WHERE delivery_town IS NOT NULL GROUP BY 1
ORDER BY sum(total_price) DESC, delivery_town ASC LIMIT 15"""),
    "revenue_by_payment": _q("""SELECT payment_method, CAST(sum(total_price) AS DOUBLE) AS total_price
FROM sales WHERE payment_method IS NOT NULL GROUP BY 1 ORDER BY 1"""),
}


# --- series and linear forecasts ---------------------------------------------

def _os(value: str, order: str = "x") -> str:
    """Ordered left fold from 0.0 (twin of ``series.ordered_sum``)."""
    return (f"list_reduce(list(CAST({value} AS DOUBLE) ORDER BY {order}), "
            f"lambda a, b: a + b, CAST(0.0 AS DOUBLE))")


_REV_SERIES = """, rs0 AS (
  SELECT 'revenue' AS series_id, date_trunc('month', invoice_date) AS month_start,
         CAST(sum(total_price) AS DECIMAL(38,6)) AS y_dec, count(*) AS lines
  FROM sales WHERE invoice_date IS NOT NULL GROUP BY 2),
rs AS (
  SELECT series_id, month_start, y_dec, CAST(y_dec AS DOUBLE) AS y
  FROM (SELECT *, sum(lines) OVER (PARTITION BY series_id) AS al,
               count(*) OVER (PARTITION BY series_id) AS nm FROM rs0)
  WHERE al >= 12 AND nm >= 12)
"""

_DEMAND_SERIES = """, pm AS (
  SELECT short_description AS series_id, date_trunc('month', invoice_date) AS month_start,
         CAST(sum(CAST(qty AS DECIMAL(30,6))) AS DECIMAL(38,6)) AS y_dec, count(*) AS lines
  FROM sales WHERE short_description IS NOT NULL AND invoice_date IS NOT NULL GROUP BY 1, 2),
totals AS (SELECT series_id, sum(y_dec) AS total, sum(lines) AS lines FROM pm GROUP BY 1),
top AS (SELECT series_id, total FROM totals WHERE (SELECT sum(lines) FROM totals) >= 30
        ORDER BY total DESC, series_id ASC LIMIT 5),
rs AS (
  SELECT series_id, month_start, y_dec, CAST(y_dec AS DOUBLE) AS y
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS nm
        FROM pm WHERE series_id IN (SELECT series_id FROM top))
  WHERE nm >= 6)
"""

_W = "(PARTITION BY series_id ORDER BY month_start)"
_WALL = "(PARTITION BY series_id)"
_WMOY = "(PARTITION BY series_id, month(month_start))"


def _lag(k: int) -> str:
    return f"lag(y, {k}) OVER {_W}"


def _rolling_mean(k: int) -> str:
    total = "y"
    for i in range(1, k):
        total = f"({total} + coalesce({_lag(i)}, CAST(0.0 AS DOUBLE)))"
    return f"({total} / CAST(least(row_number() OVER {_W}, {k}) AS DOUBLE))"


def _rolling_std3() -> str:
    n = f"CAST(least(row_number() OVER {_W}, 3) AS DOUBLE)"
    m = _rolling_mean(3)
    dev = f"((y - {m}) * (y - {m}))"
    for i in (1, 2):
        d = f"({_lag(i)} - {m})"
        dev = f"({dev} + coalesce({d} * {d}, CAST(0.0 AS DOUBLE)))"
    return f"CASE WHEN {n} > 1 THEN sqrt({dev} / ({n} - 1)) ELSE CAST(0.0 AS DOUBLE) END"


def _backfilled_lag(k: int) -> str:
    first = f"first_value(y) OVER (PARTITION BY series_id ORDER BY month_start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return (f"CASE WHEN count(*) OVER {_WALL} > {k} THEN coalesce({_lag(k)}, {first}) "
            f"ELSE CAST(0.0 AS DOUBLE) END")


_SEASONAL_FEATURE = (
    f"CASE WHEN CAST(sum(y_dec) OVER {_WALL} AS DOUBLE) / count(*) OVER {_WALL} > 0 "
    f"THEN (CAST(sum(y_dec) OVER {_WMOY} AS DOUBLE) / count(*) OVER {_WMOY}) "
    f"/ (CAST(sum(y_dec) OVER {_WALL} AS DOUBLE) / count(*) OVER {_WALL}) "
    f"ELSE CAST(1.0 AS DOUBLE) END")

_MONTH_FEATURES = f"""SELECT series_id, month_start, y,
  CAST(month(month_start) AS INTEGER) AS month,
  CAST(quarter(month_start) AS INTEGER) AS quarter,
  CAST(row_number() OVER {_W} - 1 AS BIGINT) AS months_since_start,
  {_backfilled_lag(1)} AS lag_1, {_backfilled_lag(2)} AS lag_2,
  {_backfilled_lag(3)} AS lag_3, {_backfilled_lag(12)} AS lag_12,
  {_rolling_mean(3)} AS rolling_mean_3, {_rolling_mean(6)} AS rolling_mean_6,
  {_rolling_std3()} AS rolling_std_3,
  CASE WHEN {_lag(12)} IS NOT NULL AND {_lag(12)} <> 0 THEN y / {_lag(12)} - 1.0
       ELSE CAST(0.0 AS DOUBLE) END AS yoy_growth,
  {_SEASONAL_FEATURE} AS seasonal_index
FROM rs"""

_DEMAND_FEATURES = f"""SELECT series_id, month_start, y,
  CAST(month(month_start) AS INTEGER) AS month,
  CAST(row_number() OVER {_W} - 1 AS BIGINT) AS months_since_start,
  coalesce({_lag(1)}, first_value(y) OVER (PARTITION BY series_id ORDER BY month_start
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS lag_1,
  {_rolling_mean(3)} AS rolling_mean_3,
  {_SEASONAL_FEATURE} AS seasonal_index
FROM rs"""

_SEASONAL_INDEX = f""", moy AS (
  SELECT series_id, CAST(month(month_start) AS INTEGER) AS moy,
         CAST(sum(y_dec) AS DOUBLE) / count(*) AS moy_mean
  FROM rs GROUP BY 1, 2),
ov AS (SELECT series_id, {_os('moy_mean', 'moy')} / count(*) AS overall FROM moy GROUP BY 1),
si AS (
  SELECT m.series_id, m.moy, m.moy_mean,
         CASE WHEN ov.overall > 0 THEN m.moy_mean / ov.overall ELSE CAST(1.0 AS DOUBLE) END
           AS seasonal_index
  FROM moy m JOIN ov USING (series_id))
"""


def _fit(target: str) -> str:
    return f""", s AS (
  SELECT series_id, month_start, y_dec, y,
         CAST(row_number() OVER {_W} - 1 AS DOUBLE) AS x,
         count(*) OVER {_WALL} AS n, CAST(month(month_start) AS INTEGER) AS moy
  FROM rs),
s2 AS (SELECT s.*, si.seasonal_index, s.y / si.seasonal_index AS yd
       FROM s LEFT JOIN si USING (series_id, moy)),
fit0 AS (
  SELECT series_id, CAST(count(*) AS DOUBLE) AS n_, {_os('x')} AS sx, {_os(target)} AS sy,
         {_os('x * ' + target)} AS sxy, {_os('x * x')} AS sxx,
         CAST(sum(y_dec) AS DOUBLE) / count(*) AS mean_y, max(month_start) AS last_month
  FROM s2 GROUP BY 1),
fit1 AS (SELECT *, (n_ * sxy - sx * sy) / (n_ * sxx - sx * sx) AS slope FROM fit0),
fit2 AS (SELECT *, (sy - slope * sx) / n_ AS intercept FROM fit1)
"""


_METRICS = f""", fitted AS (
  SELECT s2.*, f.slope, f.intercept, f.mean_y,
         (f.slope * s2.x + f.intercept) * s2.seasonal_index AS y_pred
  FROM s2 JOIN fit2 f USING (series_id)),
fitted2 AS (SELECT *, (n > 6 AND x >= n - 3) AS is_test, y - y_pred AS r FROM fitted),
met0 AS (
  SELECT series_id,
         {_os('CASE WHEN is_test THEN abs(r) ELSE 0.0 END')} AS abs_,
         {_os('CASE WHEN is_test THEN r * r ELSE 0.0 END')} AS sq,
         CAST(sum(CASE WHEN is_test THEN y_dec END) AS DOUBLE) / 3 AS tmean,
         {_os('r * r')} AS ss_res,
         {_os('(y - mean_y) * (y - mean_y)')} AS ss_tot,
         max(n) AS nn
  FROM fitted2 GROUP BY 1),
tss AS (
  SELECT f.series_id,
         {_os('CASE WHEN f.is_test THEN (f.y - m.tmean) * (f.y - m.tmean) ELSE 0.0 END', 'f.x')} AS tss
  FROM fitted2 f JOIN met0 m USING (series_id) GROUP BY 1),
met AS (
  SELECT series_id,
         CASE WHEN nn > 6 THEN abs_ / 3 ELSE CAST(0.0 AS DOUBLE) END AS mae,
         CASE WHEN nn > 6 THEN sqrt(sq / 3) ELSE CAST(0.0 AS DOUBLE) END AS rmse,
         CASE WHEN ss_tot > 0 THEN 1.0 - ss_res / ss_tot ELSE CAST(0.0 AS DOUBLE) END AS r2_train,
         CASE WHEN nn > 6 AND tss > 0 THEN 1.0 - sq / tss ELSE CAST(0.0 AS DOUBLE) END AS r2_test,
         sqrt(ss_tot / nn) AS pop_std
  FROM met0 JOIN tss USING (series_id))
"""


def _future(horizon: int = 6) -> str:
    return f""", fut0 AS (
  SELECT f.*, h.horizon, f.last_month + to_months(h.horizon) AS month_start
  FROM fit2 f CROSS JOIN (SELECT CAST(range AS INTEGER) AS horizon FROM range(1, {horizon + 1})) h),
fut AS (
  SELECT fut0.*, greatest((slope * (n_ - 1.0 + horizon) + intercept)
                          * coalesce(si.seasonal_index, CAST(1.0 AS DOUBLE)), 0.0) AS forecast
  FROM fut0 LEFT JOIN si ON fut0.series_id = si.series_id
                        AND CAST(month(fut0.month_start) AS INTEGER) = si.moy)
"""


_REV_FORECAST = (_REV_SERIES + _SEASONAL_INDEX + _fit("yd") + _METRICS + _future() + """,
band AS (
  SELECT fut.series_id, fut.month_start, fut.horizon, fut.forecast,
         1.96 * CASE WHEN met.rmse > 0 THEN met.rmse ELSE met.pop_std * 0.15 END
              * CAST(fut.horizon AS DOUBLE) * 0.2 AS half
  FROM fut JOIN met USING (series_id)),
rf AS (
  SELECT series_id, month_start, horizon, forecast,
         greatest(forecast - half, 0.0) AS lower_ci, forecast + half AS upper_ci
  FROM band)
""")

_DEMAND_FORECAST = _DEMAND_SERIES + _SEASONAL_INDEX + _fit("y") + _future() + """,
rf AS (SELECT series_id, month_start, horizon, forecast FROM fut)
"""

_TOTALS = f""", tot AS (
  SELECT series_id, {_os('forecast', 'horizon')} AS total_forecast, count(*) AS months
  FROM rf GROUP BY 1)
"""


def _plain(x: str, d: int) -> str:
    return f"replace(format('{{:,.{d}f}}', {x}), ',', '')"


ORACLE.update({
    "top_demand_products": _q(_DEMAND_SERIES + """
SELECT series_id AS product, CAST(total AS DOUBLE) AS total_qty FROM top"""),
    "demand_monthly": _q(_DEMAND_SERIES + "SELECT series_id, month_start, y FROM rs"),
    "month_features": _q(_REV_SERIES + _MONTH_FEATURES),
    "demand_features": _q(_DEMAND_SERIES + _DEMAND_FEATURES),
    "train_test_split": _q(_REV_SERIES + f"""SELECT series_id, month_start,
  (row_number() OVER {_W} - 1) < greatest(CAST(floor(count(*) OVER {_WALL} * 0.8) AS BIGINT),
                                          count(*) OVER {_WALL} - 6) AS is_train
FROM rs"""),
    "trend_direction": _q(_REV_SERIES + """, td AS (
  SELECT series_id, y_dec, y,
         row_number() OVER (PARTITION BY series_id ORDER BY month_start DESC) AS rd,
         count(*) OVER (PARTITION BY series_id) AS nn FROM rs),
g AS (
  SELECT series_id,
         CAST(count(CASE WHEN rd <= 6 THEN 1 END) AS DECIMAL(10,0)) AS k,
         sum(CASE WHEN rd <= 6 THEN CAST(least(nn, 6) - rd AS DECIMAL(10,0)) END) AS sx,
         sum(CASE WHEN rd <= 6 THEN y_dec END) AS sy,
         sum(CASE WHEN rd <= 6 THEN CAST(least(nn, 6) - rd AS DECIMAL(10,0)) * y_dec END) AS sxy,
         max(CASE WHEN rd = 1 THEN y END) AS last_y, max(CASE WHEN rd = 12 THEN y END) AS back12,
         max(CASE WHEN rd = nn THEN y END) AS first_y, max(nn) AS nn
  FROM td GROUP BY 1)
SELECT series_id,
  CASE WHEN k * sxy - sx * sy > 0 THEN 'up' ELSE 'down' END AS trend_direction,
  CASE WHEN nn >= 12 THEN CASE WHEN back12 > 0 THEN (last_y / back12 - 1.0) * 100.0 ELSE 0.0 END
       ELSE CASE WHEN first_y > 0 THEN (pow(last_y / first_y, 12.0 / nn) - 1.0) * 100.0 ELSE 0.0 END
  END AS growth_vs_12th_last_pct
FROM g"""),
    "seasonal_index": _q(_REV_SERIES + _SEASONAL_INDEX
                         + "SELECT series_id, moy, moy_mean, seasonal_index FROM si"),
    "revenue_forecast_linear": _q(_REV_FORECAST + "SELECT * FROM rf"),
    "linear_fit_metrics": _q(_REV_SERIES + _SEASONAL_INDEX + _fit("yd") + _METRICS + """
SELECT series_id, 'Seasonal Linear Regression' AS model_type, mae, rmse, r2_train, r2_test FROM met"""),
    "forecast_table": _q(_REV_FORECAST + """SELECT series_id, month_start,
  strftime(month_start, '%B %Y') AS month,
  '£' || format('{:,.0f}', forecast) AS predicted_revenue,
  '£' || format('{:,.0f}', lower_ci) || ' - £' || format('{:,.0f}', upper_ci) AS confidence_range
FROM rf"""),
    "forecast_totals": _q(_REV_FORECAST + _TOTALS
                          + "SELECT series_id, total_forecast, total_forecast / months AS avg_monthly, months FROM tot"),
    "demand_forecast_linear": _q(_DEMAND_FORECAST + "SELECT * FROM rf"),
    "linear_feature_importance": _q(_REV_SERIES + """SELECT s.series_id, f.feature, f.importance,
  f.feature_label, f.importance_label
FROM (SELECT DISTINCT series_id FROM rs) s
CROSS JOIN (VALUES ('trend', 0.5::DOUBLE, 'Trend', '50.0%'),
                   ('seasonality', 0.5::DOUBLE, 'Seasonality', '50.0%'))
  f(feature, importance, feature_label, importance_label)"""),
    "demand_summary": _q(_DEMAND_FORECAST + _TOTALS + f""", hist AS (
  SELECT series_id, CAST(sum(y_dec) AS DOUBLE) / count(*) AS hist_avg FROM rs GROUP BY 1),
j AS (
  SELECT h.series_id, h.hist_avg, t.total_forecast, t.total_forecast / t.months AS forecast_avg
  FROM hist h JOIN tot t USING (series_id)),
j2 AS (SELECT *, CASE WHEN hist_avg > 0 THEN (forecast_avg / hist_avg - 1.0) * 100.0 ELSE 0.0 END
               AS expected_change_pct FROM j)
SELECT series_id AS product, 'Seasonal Linear' AS model, hist_avg, forecast_avg, expected_change_pct,
  total_forecast,
  {_plain('hist_avg', 0)} AS hist_avg_label,
  {_plain('forecast_avg', 0)} AS forecast_avg_label,
  CASE WHEN expected_change_pct >= 0 THEN '+' ELSE '' END || {_plain('expected_change_pct', 1)} || '%'
    AS expected_change_label,
  {_plain('total_forecast', 0)} AS total_label
FROM j2"""),
})


# --- boosted trees: what a fit must satisfy ------------------------------------

_LAST = """, last AS (SELECT series_id, max(month_start) AS last_month FROM rs GROUP BY 1),
ahead AS (SELECT series_id, CAST(h AS INTEGER) AS horizon, last_month + to_months(CAST(h AS INTEGER)) AS month_start
          FROM last CROSS JOIN (SELECT range AS h FROM range(1, 7)))
"""

ORACLE.update({
    "revenue_forecast_gbt_checks": _q(_REV_SERIES + _LAST + """SELECT series_id, month_start, horizon,
  true AS non_negative, round(1.96 * (1 + 0.1 * (horizon - 1)), 6)::DOUBLE AS half_band_in_sigmas, true AS lower_agrees
FROM ahead"""),
    "gbt_fit_checks": _q(_REV_SERIES + """, c AS (SELECT series_id, count(*) AS n FROM rs GROUP BY 1),
t AS (SELECT *, greatest(CAST(floor(n * 0.8) AS BIGINT), n - 6) AS train FROM c)
SELECT series_id, train AS train_months, n - train AS test_months, true AS mae_agrees, true AS rmse_agrees,
  true AS r2_in_range FROM t"""),
    "feature_importance_checks": _q(_REV_SERIES + """SELECT
  CAST(CASE WHEN count(*) > 12 THEN 12 ELSE 10 END AS BIGINT) AS features, 1.0::DOUBLE AS importance_sum,
  CAST(5 AS BIGINT) AS in_place FROM rs"""),
    "demand_forecast_gbt_checks": _q(_DEMAND_SERIES + _LAST
                                     + "SELECT series_id, month_start, horizon, true AS non_negative FROM ahead"),
    "forecast_table_gbt_checks": _q(_REV_SERIES + _LAST + """SELECT series_id, month_start,
  strftime(month_start, '%B %Y') AS month, true AS value_agrees, true AS range_agrees FROM ahead"""),
    "forecast_totals_gbt_checks": _q(_REV_SERIES + _LAST + """SELECT series_id, count(*) AS months,
  true AS total_agrees, true AS average_agrees FROM ahead GROUP BY 1"""),
    "demand_summary_gbt_checks": _q(_DEMAND_SERIES + f""", hist AS (
  SELECT series_id, CAST(sum(y_dec) AS DOUBLE) / count(*) AS hist_avg FROM rs GROUP BY 1)
SELECT series_id AS product, hist_avg, {_plain('hist_avg', 0)} AS hist_avg_label, true AS change_agrees,
  true AS total_agrees FROM hist"""),
})

for _name in ("growth", "data_profile"):
    ORACLE[f"rollup_{_name.removeprefix('data_')}"] = CORRECTED_PREFIX + ORACLE[_name].removeprefix(PREFIX)
