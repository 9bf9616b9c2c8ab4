"""Column names and types of the sales-line table.

One row per invoice line. Source spreadsheets use display names
("Invoice No", "Total Price", ...); the engine works with the snake_case
names below, and ``SOURCE_NAMES`` maps between the two so a user can load a
file that still carries the display headers.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The 19 source columns a sales sheet is expected to carry,
# in the order the source defines them (display name -> our column).
SOURCE_NAMES = {
    "Invoice No": "invoice_no",
    "Invoice Date": "invoice_date",
    "Order Date": "order_date",
    "Dispatch Date": "dispatch_date",
    "Completed Date": "completed_date",
    "Company/Individual": "company",
    "Type": "type",
    "STATUS": "status",
    "Item Type": "item_type",
    "Short Description": "short_description",
    "Qty": "qty",
    "Price": "price",
    "Discount": "discount",
    "Total Price": "total_price",
    "Weight (KG)": "weight_kg",
    "Delivery Town": "delivery_town",
    "Payment Method": "payment_method",
    "Production Status": "production_status",
    "Furniture Group": "furniture_group",
}
EXPECTED_COLUMNS = list(SOURCE_NAMES.values())

# "Colour" is read by the colour reports but is not one of the expected columns.
OPTIONAL_COLUMNS = {"Colour": "colour"}

DATE_COLUMNS = ["invoice_date", "order_date", "dispatch_date", "completed_date"]
MONEY_COLUMNS = ["price", "discount", "total_price"]
MEASURE_COLUMNS = ["qty", "weight_kg"]
DERIVED_COLUMNS = ["year", "month", "quarter", "year_month"]

# Exact money: every monetary value is held as decimal(30,6) and summed exactly; quantities
# are summed in the same type. An amount beyond it raises.
MONEY = T.DecimalType(30, 6)

SALES_SCHEMA = T.StructType(
    [T.StructField("invoice_no", T.LongType(), True)]
    + [T.StructField(c, T.TimestampType(), True) for c in DATE_COLUMNS]
    + [T.StructField(c, T.StringType(), True) for c in
       ["company", "type", "status", "item_type", "short_description"]]
    + [T.StructField("qty", T.DoubleType(), False),
       T.StructField("price", MONEY, False),
       T.StructField("discount", MONEY, False),
       T.StructField("total_price", MONEY, False),
       T.StructField("weight_kg", T.DoubleType(), False)]
    + [T.StructField(c, T.StringType(), True) for c in
       ["delivery_town", "payment_method", "production_status", "furniture_group", "colour"]]
)

# Columns the six sidebar filters and the filter-value lists work on.
FILTER_VALUE_COLUMNS = ["type", "status", "product_category", "item_type",
                        "furniture_group", "colour"]
