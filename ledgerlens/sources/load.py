"""Loading and cleaning the sales table.

``clean_sales`` turns any frame of sales lines - text from a CSV export or
already-typed Parquet - into the typed table: dates parsed (bad -> null),
numbers parsed (bad or null -> 0), calendar parts derived, missing optional
columns tolerated. ``with_category`` attaches the product category by a
lookup join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as LF
from ..functions.dates import infer_layouts
from ..functions.dates import parse as parse_date
from ..schema import (DATE_COLUMNS, EXPECTED_COLUMNS, MEASURE_COLUMNS, MONEY_COLUMNS,
                      OPTIONAL_COLUMNS, SOURCE_NAMES)


def normalise_names(df: DataFrame) -> DataFrame:
    """Accept display headers ("Total Price") as well as snake_case names."""
    mapping = {**SOURCE_NAMES, **OPTIONAL_COLUMNS}
    renames = {c: mapping[c] for c in df.columns if c in mapping}
    return df.withColumnsRenamed(renames) if renames else df


def text_date_columns(df: DataFrame) -> list[str]:
    """Date columns that are text, by their own names."""
    df = normalise_names(df)
    return [c for c in DATE_COLUMNS if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]


def clean_sales(df: DataFrame, layouts: dict[str, str | None] | None = None) -> DataFrame:
    """Coerce types and derive calendar parts; columns that are absent stay absent.

    Text dates are ISO or US-style, value by value, unless ``layouts`` gives a column's one layout
    (``functions.dates.infer_layouts``)."""
    df = normalise_names(df)
    cols = set(df.columns)
    out = {}
    for c in DATE_COLUMNS:
        if c in cols and layouts and layouts.get(c):
            out[c] = parse_date(df[c], layouts[c])
        elif c in cols:
            out[c] = df[c] if isinstance(df.schema[c].dataType, T.TimestampType) \
                else LF.to_timestamp_or_null(df[c])
    for c in MONEY_COLUMNS:
        if c in cols:
            out[c] = LF.to_money(df[c], df.schema[c].dataType)
    for c in MEASURE_COLUMNS:
        if c in cols:
            out[c] = LF.to_measure(df[c], df.schema[c].dataType)
    df = df.withColumns(out) if out else df
    if "invoice_date" in cols:
        d = F.col("invoice_date")
        df = df.withColumns({
            "year": F.year(d),
            "month": F.month(d),
            "quarter": F.quarter(d),
            "year_month": LF.month_label(d),
        })
    return df


def clean_export_text(df: DataFrame) -> DataFrame:
    """``clean_sales`` over every known column: one that no file of a batch has counts as null (an
    amount then as 0), as it would next to files that have it."""
    known = EXPECTED_COLUMNS + list(OPTIONAL_COLUMNS.values())
    absent = [c for c in known if c not in df.columns]
    return clean_sales(df.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else df)


def _cleaned(raw: DataFrame, guess_dates: bool) -> DataFrame:
    columns = text_date_columns(raw) if guess_dates else []
    return clean_sales(raw, infer_layouts(normalise_names(raw), columns) if columns else None)


def read_sales(spark: SparkSession, path: str, fmt: str = "parquet", guess_dates: bool = False, **options) -> DataFrame:
    """Read a sales export. CSV is read as all-text (no schema inference), by default with
    the options that ``storage.export_csv`` writes with and each file by its own header; with
    other options Spark's reader takes the first file's header for all. ``guess_dates`` reads each
    column of text dates by the one layout of its first date (one pass over these columns)."""
    if fmt == "csv" and not options:
        from .exports import drift, list_exports, read_csv_exports
        files = list_exports(spark, path)
        if files:
            return _cleaned(read_csv_exports(spark, drift(spark, files)), guess_dates)
    if fmt == "csv":
        from .storage import CSV_READ_OPTIONS, unguard_null_marker
        raw = unguard_null_marker(spark.read.options(**{**CSV_READ_OPTIONS, **options}).csv(path))
    else:
        raw = spark.read.format(fmt).options(**options).load(path)
    return _cleaned(raw, guess_dates)


def missing_columns(df: DataFrame) -> list[str]:
    cols = set(normalise_names(df).columns)
    return [c for c in EXPECTED_COLUMNS if c not in cols]


# --- S2: product-code list -> (description, category) ------------------------

def category_column(columns: list[str]) -> str | None:
    """The first column whose name mentions 'landscape' or 'furniture'."""
    for c in columns:
        lc = c.lower()
        if "landscape" in lc or "furniture" in lc:
            return c
    return None


def read_product_codes(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame | None:
    """Read a product-code list; a missing file means no lookup (None)."""
    from pyspark.errors import AnalysisException
    try:
        if fmt == "csv":
            return spark.read.option("header", True).option("inferSchema", False).csv(path)
        return spark.read.format(fmt).load(path)
    except AnalysisException:
        return None


def product_categories(codes: DataFrame | None) -> DataFrame | None:
    """One row per description: 'Furniture' or 'Landscape'.

    Flags are compared after strip + upper. A description flagged both ways is
    Furniture ('Furniture' < 'Landscape', so ``min`` picks it). Blank or other
    flags and null descriptions are dropped. Returns None when there is no
    list or no category column (the source's empty mapping).
    """
    if codes is None:
        return None
    desc_col = next((c for c in codes.columns if c.lower() == "description"), None)
    cat_col = category_column(codes.columns)
    if desc_col is None or cat_col is None:
        return None
    flag = F.upper(LF.strip_blanks(cat_col))
    category = (F.when(flag == "F", F.lit("Furniture"))
                .when(flag == "L", F.lit("Landscape")))
    return (codes.select(F.col(desc_col).alias("description"), category.alias("category"))
            .where(F.col("description").isNotNull() & F.col("category").isNotNull())
            .groupBy("description")
            .agg(F.min("category").alias("category")))


NULL_KEY_SPREAD = 1024


def prepare_lookup(categories: DataFrame | None) -> DataFrame | None:
    """The lookup side of J1: ``(short_description, product_category)``. The planner broadcasts
    it within its size threshold and shuffles beyond."""
    if categories is None:
        return None
    return categories.select(F.col("description").alias("short_description"),
                             F.col("category").alias("product_category"))


def join_category(sales: DataFrame, lookup: DataFrame | None) -> DataFrame:
    """Left lookup join on the exact description -> ``product_category``.

    Without a lookup the column is not added (the reports then skip the
    category filter, as the source does).
    """
    if lookup is None or "short_description" not in sales.columns:
        return sales
    # a null description matches nothing; such lines are spread over many join keys that no
    # description has, instead of meeting in one task when the join shuffles
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in sales.columns if c in ("invoice_no", "qty", "total_price")], F.lit(0)),
                    F.lit(NULL_KEY_SPREAD)).cast("string")
    key = F.coalesce(F.col("short_description"), F.concat(F.lit("\0"), spread))
    side = lookup.select(F.col("short_description").alias("_key"), "product_category")
    return sales.drop("product_category").withColumn("_key", key).join(side, "_key", "left").select(
        *[c for c in sales.columns if c != "product_category"], "product_category")


def with_category(sales: DataFrame, categories: DataFrame | None) -> DataFrame:
    """J1 from a category table (``product_categories`` output)."""
    if categories is None or "short_description" not in sales.columns:
        return sales
    return join_category(sales, prepare_lookup(categories))
