"""Which layout a column of date text has.

Text dates are read by one layout per column: that of the column's first value that any layout
parses, as the source's parser guesses it (one with a 12-hour clock too, which that parser reads
value by value). Values of another layout are then unparseable. All columns are looked at in one pass, which also counts the values of each layout.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Date layouts in the order in which they are tried on a value. Month first comes before
# day first, so day first is taken only where the month would be over twelve.
DATE_LAYOUTS = ["yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy",
                "d MMM yyyy", "d-MMM-yyyy", "d/MMM/yyyy", "MMM d yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d yyyy", "MMMM d, yyyy"]
TIME_LAYOUTS = ["", " H:mm", " H:mm:ss", "'T'H:mm:ss", " h:mm a", " h:mm:ss a"]
# how a part of a layout reads
SHAPES = {"yyyyMMdd": r"\d{8}", "yyyy": r"\d{4}", "MMMM": "[A-Za-z]{4,9}", "MMM": "[A-Za-z]{3}", "mm": r"\d{2}", "ss": r"\d{2}",
          "'T'": "T", "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "h": r"\d{1,2}", "a": "[AaPp][Mm]"}
PART = re.compile("|".join(SHAPES) + "|.")


def shape(layout: str) -> str:
    """The regular expression of texts of a layout, whatever their numbers."""
    return "".join(SHAPES.get(p) or re.escape(p) for p in PART.findall(layout))


def parse(text: Column, layout: str) -> Column:
    """A text by one layout; null if it is not of that layout."""
    text = F.trim(text.cast("string"))
    return F.when(text.rlike(f"^{shape(layout)}$"), F.try_to_timestamp(text, F.lit(layout)))


def _numbered(text: Column) -> Column:
    """Place of the first layout of a text among all pairs of date and time; null without one."""
    text = F.trim(text.cast("string"))
    times = [shape(t) for t in TIME_LAYOUTS]
    time = reduce(lambda rest, i: F.when(text.rlike(f"[0-9]{times[i]}$"), F.lit(i)).otherwise(rest),
                  range(1, len(times)), F.lit(0))
    suffix = "|".join(sorted((t for t in times if t), key=len, reverse=True))
    date = F.regexp_replace(text, f"(?:{suffix})$", "")
    of_date = F.coalesce(*[F.when(date.rlike(f"^{shape(d)}$") & F.try_to_timestamp(date, F.lit(d)).isNotNull(), F.lit(i))
                           for i, d in enumerate(DATE_LAYOUTS)])
    return of_date * len(TIME_LAYOUTS) + time


def layout_counts(df: DataFrame, columns: list[str], position: Column | None = None) -> DataFrame:
    """Per column and layout (null: none): the number of values that are not null, and the first
    position; by default positions follow the order of the input's partitions and rows."""
    at = F.monotonically_increasing_id() if position is None else position
    texts = df.select(at.alias("at"), *[F.col(c).cast("string").alias(c) for c in columns])
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("e")
    layouts = F.array(*[F.lit(d + t) for d in DATE_LAYOUTS for t in TIME_LAYOUTS])
    return (texts.select("at", values).filter("e.value IS NOT NULL")
            .select("at", "e.column", _numbered(F.col("e.value")).alias("n"))
            .groupBy("column", "n").agg(F.count(F.lit(1)).alias("values"), F.min("at").alias("first"))
            .select("column", F.get(layouts, F.col("n")).alias("layout"), "values", "first"))


def infer_layouts(df: DataFrame, columns: list[str], position: Column | None = None) -> dict[str, str | None]:
    """Layout of each column, None for one without any date. One row per column reaches the driver."""
    if not columns:
        return {}
    found = (layout_counts(df, columns, position).filter("layout IS NOT NULL")
             .groupBy("column").agg(F.min_by("layout", "first").alias("layout")).collect())
    return {c: next((r["layout"] for r in found if r["column"] == c), None) for c in columns}
