"""The sales-line table derived from the driver's TPC-H-style tables.

The source system is a flat sheet of invoice lines. Our test and benchmark
data are star-schema tables, so the sheet is rebuilt from them with joins
(FIXTURES.md section 1): lineitem -> orders -> customer -> nation, and
lineitem -> part. Nulls are put in by key arithmetic that Spark and DuckDB
evaluate alike.

Join order is chosen for size: orders is enriched with its customer and
nation first (orders is a quarter of lineitem), so the lineitem-sized data
is shuffled once for the order join and once for the part join. ``nation``
is a fixed 25-row dimension and is the only side hinted for broadcast. The
lineitem-orders join is pinned to sort-merge (it joins two fact tables);
the customer and part joins are left to the planner's size check
(broadcast while a side is under the threshold, sort-merge beyond it).

Every function here returns a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MONEY

# the test tables' amounts, rounded to four decimals alike in Spark and DuckDB
CENTS = "decimal(18,4)"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_paths(sf_dir: str, names: list[str]) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names]


SALES_SOURCE_TABLES = ["lineitem", "orders", "customer", "nation", "part"]
PRODUCT_SOURCE_TABLES = ["part"]


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # nation is a fixed-size dimension (25 rows by definition): broadcast is bounded.
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")

    # orders -> customer first, so the planner compares the two real tables (a
    # customer-nation product would look larger than orders and flip the build side).
    orders_c = (orders.join(customer, orders.o_custkey == customer.c_custkey)
                .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey))
    # Fact-to-fact join: never a broadcast candidate, whatever the file-size estimate
    # says (compressed Parquet sizes understate the in-memory size several times).
    lines = li.hint("merge").join(orders_c, li.l_orderkey == orders_c.o_orderkey)
    return lines.join(part, lines.l_partkey == part.p_partkey)


def _product_description(brand: Column, name: Column) -> Column:
    return F.concat(brand, F.lit(" "), F.split_part(name, F.lit(" "), F.lit(2)))


def _colour() -> Column:
    return (F.when(F.col("p_partkey") % 31 == 0, F.lit(None))
            .when(F.col("p_partkey") % 29 == 0, F.lit(""))
            .otherwise(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))))


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed sales lines (schema ``SALES_SCHEMA``), before category enrichment."""
    j = _joined(spark, sf_dir)
    ts = lambda c: F.col(c).cast("timestamp")  # noqa: E731  (NTZ in the files -> session TZ)
    return j.select(
        F.col("l_orderkey").alias("invoice_no"),
        _null_when(F.col("o_orderkey") % 47 == 0, ts("o_orderdate")).alias("invoice_date"),
        ts("o_orderdate").alias("order_date"),
        ts("l_shipdate").alias("dispatch_date"),
        _null_when(F.col("l_linestatus") == "O", ts("l_shipdate")).alias("completed_date"),
        _null_when(F.col("c_custkey") % 43 == 0, F.col("c_name")).alias("company"),
        _null_when(F.col("c_custkey") % 17 == 0, F.col("c_mktsegment")).alias("type"),
        _null_when(F.col("o_orderkey") % 23 == 0, F.col("o_orderstatus")).alias("status"),
        _null_when(F.col("p_partkey") % 19 == 0, F.col("p_type")).alias("item_type"),
        _null_when(F.col("p_partkey") % 53 == 0,
                   _product_description(F.col("p_brand"), F.col("p_name"))).alias("short_description"),
        F.col("l_quantity").cast("double").alias("qty"),
        F.col("p_retailprice").cast(CENTS).cast(MONEY).alias("price"),
        (F.col("l_extendedprice") * F.col("l_discount")).cast(CENTS).cast(MONEY).alias("discount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(CENTS).cast(MONEY).alias("total_price"),
        (F.col("l_quantity") * F.col("p_size")).cast("double").alias("weight_kg"),
        _null_when(F.col("c_custkey") % 37 == 0, F.col("n_name")).alias("delivery_town"),
        _null_when(F.col("o_orderkey") % 11 == 0, F.col("o_orderpriority")).alias("payment_method"),
        F.col("l_linestatus").alias("production_status"),
        _null_when(F.col("p_partkey") % 13 == 0, F.col("p_brand")).alias("furniture_group"),
        _colour().alias("colour"),
    )


def sales_lines_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column as text, with unparseable values, as a sheet export would hold them."""
    j = _joined(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    bad_qty = (F.col("l_linenumber") == 7) & (F.col("l_partkey") % 7 == 0)
    return j.select(
        s("l_orderkey").alias("invoice_no"),
        F.when(F.col("o_orderkey") % 47 == 0, F.lit("not a date"))
         .otherwise(s("o_orderdate")).alias("invoice_date"),
        s("o_orderdate").alias("order_date"),
        s("l_shipdate").alias("dispatch_date"),
        _null_when(F.col("l_linestatus") == "O", s("l_shipdate")).alias("completed_date"),
        _null_when(F.col("c_custkey") % 43 == 0, F.col("c_name")).alias("company"),
        _null_when(F.col("c_custkey") % 17 == 0, F.col("c_mktsegment")).alias("type"),
        _null_when(F.col("o_orderkey") % 23 == 0, F.col("o_orderstatus")).alias("status"),
        _null_when(F.col("p_partkey") % 19 == 0, F.col("p_type")).alias("item_type"),
        _null_when(F.col("p_partkey") % 53 == 0,
                   _product_description(F.col("p_brand"), F.col("p_name"))).alias("short_description"),
        F.when(bad_qty, F.lit("n/a")).otherwise(s("l_quantity")).alias("qty"),
        # amounts beyond 1e14 and with six decimals, as text
        F.when(F.col("l_partkey") % 97 == 0, F.lit("1125899906842624.000000"))
         .when(F.col("l_partkey") % 89 == 0, F.lit(" 0.015625 "))
         .otherwise(F.col("p_retailprice").cast(CENTS).cast("string")).alias("price"),
        (F.col("l_extendedprice") * F.col("l_discount")).cast(CENTS).cast("string").alias("discount"),
        _null_when(F.col("l_partkey") % 61 == 0,
                   (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(CENTS).cast("string")
                   ).alias("total_price"),
        (F.col("l_quantity") * F.col("p_size")).cast("double").cast("string").alias("weight_kg"),
        _null_when(F.col("c_custkey") % 37 == 0, F.col("n_name")).alias("delivery_town"),
        _null_when(F.col("o_orderkey") % 11 == 0, F.col("o_orderpriority")).alias("payment_method"),
        F.col("l_linestatus").alias("production_status"),
        _null_when(F.col("p_partkey") % 13 == 0, F.col("p_brand")).alias("furniture_group"),
        _colour().alias("colour"),
    )


def product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product-code list: ``description`` plus a landscape/furniture flag column.

    One row per part, so descriptions repeat; some descriptions carry both
    flags, some carry blank or no flag (FIXTURES.md section 2).
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    b = F.substring(F.col("p_brand"), 7, 100).try_cast("int")
    flag = (F.when(b.isin(1, 4) & (F.col("p_size") % 2 == 1), F.lit("F"))
            .when(b % 3 == 0, F.lit("F"))
            .when((b % 3 == 1) & (F.col("p_size") % 3 == 0), F.lit("\tL\n"))
            .when((b % 3 == 1) & (F.col("p_size") % 3 == 1), F.lit("\u00a0l\u2003"))
            .when(b % 3 == 1, F.lit(" l "))
            .otherwise(F.lit(None).cast("string")))
    return p.select(
        _null_when(F.col("p_partkey") % 41 == 0,
                   _product_description(F.col("p_brand"), F.col("p_name"))).alias("description"),
        flag.alias("landscape_or_furniture"),
    )


# --- the same tables in DuckDB SQL, for the oracle ---------------------------

SALES_SQL = """
SELECT
  l.l_orderkey AS invoice_no,
  CASE WHEN o.o_orderkey % 47 = 0 THEN NULL ELSE o.o_orderdate END AS invoice_date,
  o.o_orderdate AS order_date,
  l.l_shipdate AS dispatch_date,
  CASE WHEN l.l_linestatus = 'O' THEN NULL ELSE l.l_shipdate END AS completed_date,
  CASE WHEN c.c_custkey % 43 = 0 THEN NULL ELSE c.c_name END AS company,
  CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE c.c_mktsegment END AS type,
  CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE o.o_orderstatus END AS status,
  CASE WHEN p.p_partkey % 19 = 0 THEN NULL ELSE p.p_type END AS item_type,
  CASE WHEN p.p_partkey % 53 = 0 THEN NULL
       ELSE p.p_brand || ' ' || split_part(p.p_name, ' ', 2) END AS short_description,
  CAST(l.l_quantity AS DOUBLE) AS qty,
  CAST(p.p_retailprice AS DECIMAL(18,4)) AS price,
  CAST(l.l_extendedprice * l.l_discount AS DECIMAL(18,4)) AS discount,
  CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS total_price,
  CAST(l.l_quantity * p.p_size AS DOUBLE) AS weight_kg,
  CASE WHEN c.c_custkey % 37 = 0 THEN NULL ELSE n.n_name END AS delivery_town,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderpriority END AS payment_method,
  l.l_linestatus AS production_status,
  CASE WHEN p.p_partkey % 13 = 0 THEN NULL ELSE p.p_brand END AS furniture_group,
  CASE WHEN p.p_partkey % 31 = 0 THEN NULL WHEN p.p_partkey % 29 = 0 THEN ''
       ELSE split_part(p.p_name, ' ', 1) END AS colour
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

SALES_RAW_SQL = """
SELECT
  CAST(l.l_orderkey AS VARCHAR) AS invoice_no,
  CASE WHEN o.o_orderkey % 47 = 0 THEN 'not a date' ELSE CAST(o.o_orderdate AS VARCHAR) END AS invoice_date,
  CAST(o.o_orderdate AS VARCHAR) AS order_date,
  CAST(l.l_shipdate AS VARCHAR) AS dispatch_date,
  CASE WHEN l.l_linestatus = 'O' THEN NULL ELSE CAST(l.l_shipdate AS VARCHAR) END AS completed_date,
  CASE WHEN c.c_custkey % 43 = 0 THEN NULL ELSE c.c_name END AS company,
  CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE c.c_mktsegment END AS type,
  CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE o.o_orderstatus END AS status,
  CASE WHEN p.p_partkey % 19 = 0 THEN NULL ELSE p.p_type END AS item_type,
  CASE WHEN p.p_partkey % 53 = 0 THEN NULL
       ELSE p.p_brand || ' ' || split_part(p.p_name, ' ', 2) END AS short_description,
  CASE WHEN l.l_linenumber = 7 AND l.l_partkey % 7 = 0 THEN 'n/a'
       ELSE CAST(l.l_quantity AS VARCHAR) END AS qty,
  CASE WHEN l.l_partkey % 97 = 0 THEN '1125899906842624.000000' WHEN l.l_partkey % 89 = 0 THEN ' 0.015625 '
       ELSE CAST(CAST(p.p_retailprice AS DECIMAL(18,4)) AS VARCHAR) END AS price,
  CAST(CAST(l.l_extendedprice * l.l_discount AS DECIMAL(18,4)) AS VARCHAR) AS discount,
  CASE WHEN l.l_partkey % 61 = 0 THEN NULL
       ELSE CAST(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS VARCHAR) END AS total_price,
  CAST(CAST(l.l_quantity * p.p_size AS DOUBLE) AS VARCHAR) AS weight_kg,
  CASE WHEN c.c_custkey % 37 = 0 THEN NULL ELSE n.n_name END AS delivery_town,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderpriority END AS payment_method,
  l.l_linestatus AS production_status,
  CASE WHEN p.p_partkey % 13 = 0 THEN NULL ELSE p.p_brand END AS furniture_group,
  CASE WHEN p.p_partkey % 31 = 0 THEN NULL WHEN p.p_partkey % 29 = 0 THEN ''
       ELSE split_part(p.p_name, ' ', 1) END AS colour
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

PRODUCT_CODES_SQL = """
SELECT
  CASE WHEN p_partkey % 41 = 0 THEN NULL
       ELSE p_brand || ' ' || split_part(p_name, ' ', 2) END AS description,
  CASE WHEN TRY_CAST(substr(p_brand, 7) AS INTEGER) IN (1, 4) AND p_size % 2 = 1 THEN 'F'
       WHEN TRY_CAST(substr(p_brand, 7) AS INTEGER) % 3 = 0 THEN 'F'
       WHEN TRY_CAST(substr(p_brand, 7) AS INTEGER) % 3 = 1 AND p_size % 3 = 0 THEN chr(9) || 'L' || chr(10)
       WHEN TRY_CAST(substr(p_brand, 7) AS INTEGER) % 3 = 1 AND p_size % 3 = 1 THEN chr(160) || 'l' || chr(8195)
       WHEN TRY_CAST(substr(p_brand, 7) AS INTEGER) % 3 = 1 THEN ' l '
       ELSE NULL END AS landscape_or_furniture
FROM part
"""
