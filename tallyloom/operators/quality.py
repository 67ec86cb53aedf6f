"""Data-quality checks: all row counts in one aggregate, a score, and messages in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources.schema import (
    NUMERIC_COLUMNS,
    REQUIRED_COLUMNS,
    STOCK_COLUMNS,
    coerce_types,
    day_layout,
    missing_columns,
    standardise_columns,
)
from tallyloom.sources.tables import fits_broadcast, settle

# Fixed value: share of purchases lost that makes a row a high-waste row.
HIGH_WASTE_SHARE = 0.25
# Fixed value: standard deviations above the mean that make a sale an outlier.
OUTLIER_SPREAD = 3

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("data_quality_score", T.LongType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("row_count", T.LongType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Check:
    """One check: its count column, message, and the points each finding costs up to a cap."""

    count: str
    message: str
    points: int
    cap: int
    is_error: bool = True


def checks() -> list[Check]:
    """Messages and penalties, in report order."""
    return [
        Check("duplicate_rows", "Found %d duplicate rows.", 1, 10, is_error=False),
        Check("bad_date", "Found %d rows with invalid dates.", 2, 15),
        *[Check(f"bad_{c}", f"Column '{c}' has %d invalid numeric values.", 2, 10) for c in NUMERIC_COLUMNS],
        Check("missing_cells", "Found %d missing values in required columns.", 1, 20),
        *[Check(f"negative_{c}", f"Column '{c}' has %d negative values.", 2, 15) for c in STOCK_COLUMNS],
        Check("empty_names", "Found %d rows with empty product names.", 2, 10),
        Check(
            "equation_breaks", "Found %d rows where closing stock does not match inventory equation.", 1, 25
        ),
        Check(
            "impossible_sales", "Found %d rows where sold quantity is greater than available stock.", 2, 20
        ),
        Check("high_waste_rows", "Found %d rows with wastage rate above 25%%.", 1, 10, is_error=False),
        Check("sales_outliers", "Found %d possible sales outliers.", 1, 10, is_error=False),
    ]


def coerce_count_exprs() -> list[Column]:
    """Values that did not survive coercion (missing ones count as well)."""
    return [F.count_if(F.col(c).isNull()).alias(f"bad_{c}") for c in ("date", *NUMERIC_COLUMNS)]


def quality_count_exprs() -> list[Column]:
    expected = (
        F.col("opening_stock") + F.col("purchased_quantity") - F.col("sold_quantity") - F.col("wasted_quantity")
    )
    closing = F.col("closing_stock")
    holds = F.coalesce(F.round(expected, 2) == F.round(closing, 2), F.lit(False))
    available = F.col("opening_stock") + F.col("purchased_quantity")
    missing = sum((F.count_if(F.col(c).isNull()) for c in REQUIRED_COLUMNS), F.lit(0))
    return [
        missing.alias("missing_cells"),
        *[F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in STOCK_COLUMNS],
        F.count_if(F.trim("product_name") == "").alias("empty_names"),
        F.count_if(~holds).alias("equation_breaks"),
        F.count_if(F.col("sold_quantity") > available).alias("impossible_sales"),
        F.count_if(
            F.try_divide("wasted_quantity", "purchased_quantity") > HIGH_WASTE_SHARE
        ).alias("high_waste_rows"),
    ]


def coerce_counts(coerced: DataFrame) -> DataFrame:
    return coerced.agg(*coerce_count_exprs())


def quality_counts(coerced: DataFrame) -> DataFrame:
    return coerced.agg(*quality_count_exprs())


def outlier_threshold(coerced: DataFrame) -> Column:
    """Mean plus three sample deviations, as a scalar subquery over the one column it reads; NULL without spread."""
    sold = F.col("sold_quantity")
    spread = F.stddev_samp(sold)
    limit = F.when(spread > 0, F.avg(sold) + OUTLIER_SPREAD * spread)
    return coerced.agg(limit.alias("limit")).scalar()


def outlier_count_expr() -> Column:
    return F.count_if(F.col("sold_quantity") > F.col("outlier_limit")).alias("sales_outliers")


def sales_outliers(coerced: DataFrame) -> DataFrame:
    flagged = coerced.select("sold_quantity").withColumn("outlier_limit", outlier_threshold(coerced))
    return flagged.agg(outlier_count_expr())


def duplicate_rows(raw: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column.

    A first job groups 8-byte row hashes, which is all it shuffles of the table. Rows whose hash occurs more than
    once are then compared column by column, so the count is exact whatever the hash does. The repeated hashes are
    broadcast only when their counted number is small, so in a ledger with few copies full rows are never shuffled.
    """
    rows = raw.select(F.struct("*").alias("row"))
    hashed = rows.withColumn("row_hash", F.xxhash64("row"))
    repeated = hashed.groupBy("row_hash").count().filter("count > 1").select("row_hash")
    repeated = settle(repeated, "repeated-rows")
    if fits_broadcast(repeated):
        repeated = F.broadcast(repeated)
    suspects = hashed.join(repeated, "row_hash", "left_semi")
    copies = suspects.groupBy("row_hash", "row").agg((F.count("*") - 1).alias("extra"))
    return copies.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"))


def all_counts(raw: DataFrame, layout: str | None = None) -> DataFrame:
    """Every check count plus `row_count`, in one row: one main scan, with subqueries for the outlier limit and the copies."""
    coerced = coerce_types(raw, layout)
    counted = coerced.withColumn("outlier_limit", outlier_threshold(coerced)).agg(
        F.count("*").alias("row_count"),
        *coerce_count_exprs(),
        *quality_count_exprs(),
        outlier_count_expr(),
    )
    return counted.withColumn("duplicate_rows", duplicate_rows(raw).scalar())


def score_report(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Verdict, score and messages from the 1-row count frame."""

    def messages(errors: bool) -> Column:
        slots = [
            F.when(F.col(c.count) > 0, F.format_string(c.message, F.col(c.count)))
            for c in checks()
            if c.is_error == errors
        ]
        return F.array_compact(F.array(*slots))

    lost = sum((F.least(F.col(c.count) * c.points, F.lit(c.cap)) for c in checks()), F.lit(0))
    return counts.select(
        (F.size(messages(True)) == 0).alias("is_valid"),
        F.greatest(F.lit(100) - lost, F.lit(0)).cast("long").alias("data_quality_score"),
        messages(True).alias("errors"),
        messages(False).alias("warnings"),
        "row_count",
        F.array(*[F.lit(c) for c in columns]).alias("columns"),
    )


@dataclass(frozen=True)
class Validation:
    """A 1-row report and the cleaned ledger; both lazy."""

    report: DataFrame
    cleaned: DataFrame


def validate(df: DataFrame) -> Validation:
    """Check a ledger. Without all required columns nothing else is checked.

    Text dates are read in the one layout that most cells of the column follow; a cell in another one is an invalid date.
    """
    named = standardise_columns(df)
    missing = missing_columns(named)
    if missing:
        message = f"Missing required columns: {missing}"
        score = 100 - min(30, 5 * len(missing))
        report = named.agg(F.count("*").alias("row_count")).select(
            F.lit(False).alias("is_valid"),
            F.lit(score).cast("long").alias("data_quality_score"),
            F.array(F.lit(message)).alias("errors"),
            F.array().cast("array<string>").alias("warnings"),
            "row_count",
            F.array(*[F.lit(c) for c in named.columns]).alias("columns"),
        )
        return Validation(report, named)
    layout = day_layout(named)
    return Validation(score_report(all_counts(named, layout), named.columns), coerce_types(named, layout))
