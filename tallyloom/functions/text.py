"""Text formats of the reports and answers."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import INF


def money_text(value: Column) -> Column:
    return F.format_string("$%,.2f", value)


def percent_text(value: Column) -> Column:
    return F.format_string("%.1f%%", value * 100)


def days_number(value: Column) -> Column:
    """One decimal; infinity and a missing number are spelled out."""
    return (
        F.when(value.isNull(), F.lit("nan"))
        .when(value == INF, F.lit("inf"))
        .otherwise(F.format_string("%.1f", value))
    )


def days_text(value: Column) -> Column:
    return F.when(value == INF, F.lit("Not available")).otherwise(F.concat(days_number(value), F.lit(" days")))


def count_text(value: Column) -> Column:
    return F.format_string("%,d", value.cast("long"))


def fill(template: str, **values: Column) -> Column:
    """A text column from a template with `{name}` slots."""
    pieces: list[Column] = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if slot:
            pieces.append(values[slot])
    return F.concat(*pieces)
