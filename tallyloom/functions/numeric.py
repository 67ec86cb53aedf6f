"""Number and date expressions: coercion, guarded division, exact money sums, rounding."""

from __future__ import annotations

import re
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")

# Accepted date layouts, tried in this order.
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy-M-d HH:mm:ss[.SSSSSS]",
    "yyyy-M-d'T'HH:mm:ss[.SSSSSS]",
    "yyyy/M/d",
    "M/d/yyyy",
)

# Day layouts that a date column may follow; where two fit as many cells, the earlier one counts.
DAY_LAYOUTS = (
    "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy", "yyyyMMdd",
    "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy",
)
# A time of day after the day, with or without a zone.
CLOCK_PATTERN = r"[T ]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d([.,]\d+)?)?\s?([AaPp][Mm])?\s?(Z|UTC|[+-]\d\d:?\d\d)?$"

# Fixed value: what counts as a number in text. Keeps Java suffixes such as '1d' and grouped digits out.
NUMBER_PATTERN = r"(?i)^\s*[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf|infinity)\s*$"


def parse_number(column: Column, data_type: T.DataType) -> Column:
    """Double from any scalar column; text that is no number, and NaN, become NULL."""
    if isinstance(data_type, T.StringType):
        value = F.when(column.rlike(NUMBER_PATTERN), F.trim(column)).try_cast("double")
    else:
        value = column.try_cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def parse_day(column: Column, data_type: T.DataType, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """Calendar day from a date, timestamp or text column; anything unreadable becomes NULL."""
    if isinstance(data_type, T.DateType):
        return column
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(column)
    text = F.trim(column.cast("string"))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def without_clock(column: Column) -> Column:
    return F.regexp_replace(F.trim(column), CLOCK_PATTERN, "")


def parse_layout(column: Column, layout: str) -> Column:
    """Calendar day as written, from text in one of DAY_LAYOUTS and perhaps a time of day; anything else becomes NULL."""
    return parse_written_day(without_clock(column), layout)


def parse_written_day(day: Column, layout: str) -> Column:
    return F.when(day.rlike(_shape(layout)), F.to_date(F.try_to_timestamp(day, F.lit(layout))))


def _shape(layout: str) -> str:
    """What text in the layout looks like: far cheaper to test than a date that can't be read."""
    kinds = {"yyyy": r"\d{4}", "MM": r"\d{2}", "dd": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}", "MMM": r"\w{3}", "MMMM": r"\w{3,9}"}
    runs = re.findall(r"y+|M+|d+|[^yMd]", layout)
    return "^" + "".join(kinds.get(r) or re.escape(r) for r in runs) + "$"


def finite_or_zero(value: Column) -> Column:
    """NULL, NaN and infinities become 0 (NaN sorts above infinity in Spark, so one comparison is enough)."""
    return F.when(F.abs(value) < F.lit(INF), value).otherwise(F.lit(0.0))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 where it has no finite value."""
    return finite_or_zero(F.try_divide(numerator, denominator))


def half_even_long(value: Column) -> Column:
    """Nearest whole number, ties to even, as a long."""
    return F.bround(value).try_cast("long")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


# Money is summed exactly, so totals do not depend on partitioning or on task retries. A value is split into whole
# units and millionths, both summed as longs: that is as cheap as summing doubles, and far cheaper than decimals. What
# longs cannot hold exactly (2^53 and more, infinity) is summed as a double in a third column.
MICROS = 1_000_000
EXACT_LIMIT = float(2**53)


def _parts(name: str) -> tuple[str, str, str]:
    return f"{name}_units", f"{name}_micros", f"{name}_rest"


def money_sums(values: dict[str, Column]) -> list[Column]:
    """First-level aggregates: three parts for every money value."""
    out = []
    for name, value in values.items():
        units, micros, rest = _parts(name)
        exact = F.abs(value) < EXACT_LIMIT
        whole = F.floor(value)
        out.append(F.sum(F.when(exact, whole)).alias(units))
        out.append(F.sum(F.when(exact, F.rint((value - whole) * MICROS).cast("long"))).alias(micros))
        out.append(F.sum(F.when(~exact, value)).alias(rest))
    return out


def money_resums(names: Iterable[str]) -> list[Column]:
    """Second-level aggregates over the output of `money_sums`."""
    return [F.sum(part).alias(part) for name in names for part in _parts(name)]


def money_total(name: str) -> Column:
    """Double total from the three parts, rounded once."""
    units, micros, rest = _parts(name)
    fraction = F.col(micros).cast("decimal(20,0)") * F.lit(Decimal(1) / MICROS)
    exact = (F.col(units).cast("decimal(26,6)") + fraction).cast("double")
    return F.coalesce(exact, F.lit(0.0)) + F.coalesce(F.col(rest), F.lit(0.0))
