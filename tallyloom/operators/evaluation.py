"""Holdout evaluation of the moving-average forecast, on selling days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numeric import finite_or_zero
from tallyloom.operators.forecast import WINDOW_DAYS, daily_demand
from tallyloom.sources.schema import DEMAND_COLUMNS, PRODUCT_KEYS, require_columns


def actual_demand(daily: DataFrame) -> DataFrame:
    require_columns(daily, "forecast evaluation", DEMAND_COLUMNS)
    return daily_demand(daily).withColumnRenamed("sold_quantity", "actual_demand")


def forecast_eval(demand: DataFrame, window_days: int = WINDOW_DAYS, test_days: int = WINDOW_DAYS) -> DataFrame:
    """The last `test_days` rows of each product against the mean of the `window_days` rows before them.

    Products need more rows than both windows together, so window + test + 1 rows per product decide everything; the
    rank filter lets Spark cut each product to that many rows before the shuffle.
    """
    if window_days <= 0:
        raise ValueError(f"window_days must be greater than 0, got {window_days}")
    if test_days <= 0:
        raise ValueError(f"test_days must be greater than 0, got {test_days}")
    needed = window_days + test_days + 1
    product = Window.partitionBy("product_id")
    newest_first = product.orderBy(F.desc("date"), F.desc("product_name"), F.desc("category"))
    recent = demand.withColumn("age", F.row_number().over(newest_first)).filter(F.col("age") <= needed)
    age, actual = F.col("age"), F.col("actual_demand")
    trained = F.avg(F.when((age > test_days) & (age < needed), actual)).over(product)
    scored = recent.withColumns({"rows": F.max(age).over(product), "mean": trained})
    tested = scored.filter((F.col("rows") == needed) & (age <= test_days))
    return tested.select(
        "date",
        *PRODUCT_KEYS,
        "actual_demand",
        F.round("mean", 2).alias("predicted_demand"),
        F.abs(actual - F.col("mean")).alias("absolute_error"),
    )


def forecast_metrics(evaluation: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE from the rounded predictions; zero actuals stay out of MAPE; all 0 without rows."""
    actual = F.col("actual_demand")
    error = actual - F.col("predicted_demand")

    def metric(value):
        return F.round(finite_or_zero(value), 4)

    return evaluation.agg(
        metric(F.avg(F.abs(error))).alias("mae"),
        metric(F.sqrt(F.avg(error * error))).alias("rmse"),
        metric(F.avg(F.abs(F.try_divide(error, actual))) * 100).alias("mape"),
        F.count_distinct("product_id").alias("evaluated_products"),
    )
