"""The ledger schema and the name and type rules every entry point applies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.numeric import (
    DAY_LAYOUTS,
    parse_day,
    parse_layout,
    parse_number,
    parse_written_day,
    without_clock,
)

# The columns a ledger must have, in this order.
REQUIRED_COLUMNS = (
    "date",
    "store_id",
    "product_id",
    "product_name",
    "category",
    "opening_stock",
    "purchased_quantity",
    "sold_quantity",
    "wasted_quantity",
    "closing_stock",
    "unit_price",
)
STOCK_COLUMNS = REQUIRED_COLUMNS[5:10]
NUMERIC_COLUMNS = REQUIRED_COLUMNS[5:11]
KEY_COLUMNS = REQUIRED_COLUMNS[1:5]
PRODUCT_KEYS = ("product_id", "product_name", "category")
DEMAND_COLUMNS = ("date", *PRODUCT_KEYS, "sold_quantity")


def normalise_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def standardise_columns(df: DataFrame) -> DataFrame:
    """Lower-case snake names. Two columns that end up with one name are an error."""
    names = [normalise_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"Column names collide after normalisation: {clashes}")
    return df if names == df.columns else df.toDF(*names)


def missing_columns(df: DataFrame, required: Iterable[str] = REQUIRED_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, purpose: str, required: Iterable[str] = REQUIRED_COLUMNS) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns for {purpose}: {missing}")


def day_layout(df: DataFrame, column: str = "date") -> str | None:
    """The layout of DAY_LAYOUTS that most cells of a text column follow, the first of them where several fit as many.

    One pass over that column alone. Cells are counted by their day, combined before the shuffle, so that layouts are tried
    on distinct days only; one row of counts reaches the driver. None if the column isn't text or no cell fits any layout.
    """
    if not isinstance(df.schema[column].dataType, T.StringType):
        return None
    days = df.groupBy(without_clock(F.col(column)).alias("day")).agg(F.count("*").alias("cells"))
    fits = [F.when(parse_written_day(F.col("day"), f).isNotNull(), F.col("cells")).otherwise(0) for f in DAY_LAYOUTS]
    counts = days.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"fits{i}") for i, c in enumerate(fits)]).first()
    most = max(counts)
    return DAY_LAYOUTS[counts.index(most)] if most else None


def coerce_types(df: DataFrame, layout: str | None = None) -> DataFrame:
    """Force the ledger types in one projection; unreadable values become NULL, extra columns pass through.

    With a layout (see day_layout) text dates must follow it; without one every cell may follow any of DATE_FORMATS.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    in_layout = layout and isinstance(types["date"], T.StringType)
    parsed = {"date": parse_layout(F.col("date"), layout) if in_layout else parse_day(F.col("date"), types["date"])}
    parsed |= {c: parse_number(F.col(c), types[c]) for c in NUMERIC_COLUMNS}
    parsed |= {c: F.col(c).cast("string") for c in KEY_COLUMNS if not isinstance(types[c], T.StringType)}
    return df.withColumns(parsed)
