"""Demand series, calendar fill, and the explainable 30-day forecast with safety stock and reorder quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numeric import INF, finite_or_zero, half_even_long, safe_ratio
from tallyloom.functions.rules import (
    HIGH,
    MEDIUM,
    confidence_class,
    forecast_risk_class,
    grade_rank,
    trend_class,
)
from tallyloom.operators.kpi import with_keys
from tallyloom.sources.schema import DEMAND_COLUMNS, PRODUCT_KEYS, require_columns

# Forecast horizon and window, and the largest trend effect.
HORIZON_DAYS = 30
WINDOW_DAYS = 14
TREND_CAP = 0.25


def daily_demand(daily: DataFrame) -> DataFrame:
    """Sold quantity per day and product variant. Takes the daily rollup or any enriched ledger."""
    require_columns(daily, "forecasting", DEMAND_COLUMNS)
    keyed = with_keys(daily, "date", *PRODUCT_KEYS)
    return keyed.groupBy("date", *PRODUCT_KEYS).agg(F.sum("sold_quantity").alias("sold_quantity"))


def _selling_days(demand: DataFrame, clustered: bool) -> DataFrame:
    """One row per product and selling day, clustered by product for everything that follows.

    The input is aggregated by day, so a product has at most one row per variant and day here. Demand over a bucketed
    rollup is clustered as it is read.
    """
    dealt = demand if clustered else demand.repartition("product_id")
    return (
        dealt.groupBy("product_id", "date")
        .agg(
            F.sum("sold_quantity").alias("sold_quantity"),
            F.min(F.struct("product_name", "category")).alias("label"),
        )
    )


def demand_calendar(demand: DataFrame, clustered: bool = False) -> DataFrame:
    """Every day from the first to the last sale of each product; days without a row have demand 0.

    Each selling day expands to the days before the next one, so the fill needs no calendar table and no join, and a
    filled day carries the names of the selling day before it.
    """
    ahead = F.lead("date").over(Window.partitionBy("product_id").orderBy("date"))
    until = F.coalesce(F.date_sub("next_date", 1), F.col("date"))
    days = _selling_days(demand, clustered).withColumn("next_date", ahead)
    filled = days.withColumn("day", F.explode(F.sequence("date", until)))
    return filled.select(
        F.col("day").alias("date"),
        "product_id",
        F.col("label.product_name").alias("product_name"),
        F.col("label.category").alias("category"),
        F.when(F.col("day") == F.col("date"), F.col("sold_quantity")).otherwise(0.0).alias("sold_quantity"),
    )


def demand_windows(demand: DataFrame, window_days: int = WINDOW_DAYS, clustered: bool = False) -> DataFrame:
    """Per product: length of history, mean, spread, and the means of the recent and the previous window.

    Figures are over calendar days, computed from selling days alone: a day without sales adds nothing to a sum, and
    its share of the variance has a closed form. With a history shorter than two windows the previous one overlaps.
    """
    if window_days <= 0:
        raise ValueError("recent_window_days must be greater than 0.")
    w = F.lit(window_days)
    last = F.max("date").over(Window.partitionBy("product_id"))
    first = F.min("date").over(Window.partitionBy("product_id"))
    placed = _selling_days(demand, clustered).withColumns({"last": last, "first": first})
    placed = placed.withColumns(
        {"day_no": F.date_diff("date", "first"), "history_days": F.date_diff("last", "first") + 1}
    )
    sold, day_no, history = F.col("sold_quantity"), F.col("day_no"), F.col("history_days")

    def sum_of(start: Column) -> Column:
        return F.coalesce(F.sum(F.when((day_no >= start) & (day_no < start + w), sold)), F.lit(0.0))

    sums = placed.groupBy("product_id").agg(
        F.min_by("label", "date").alias("label"),
        F.max("history_days").cast("long").alias("history_days"),
        F.count("*").alias("selling_days"),
        F.sum(sold).alias("total"),
        F.avg(sold).alias("selling_mean"),
        F.var_pop(sold).alias("selling_var"),
        sum_of(history - F.least(history, w)).alias("recent"),
        sum_of(history - F.least(history, 2 * w)).alias("previous"),
    )
    n, k, mean = F.col("history_days"), F.col("selling_days"), F.col("selling_mean")
    width = F.least(F.col("history_days"), w)
    variance = (k * F.col("selling_var") + mean * mean * k * (n - k) / n) / n
    return sums.select(
        "product_id",
        F.col("label.product_name").alias("product_name"),
        F.col("label.category").alias("category"),
        "history_days",
        (F.col("total") / n).alias("avg_daily_demand"),
        (F.col("recent") / width).alias("recent_avg_daily_demand"),
        (F.col("previous") / width).alias("previous_avg_daily_demand"),
        F.sqrt(variance).alias("demand_std"),
    )


def stock_by_product(performance: DataFrame) -> DataFrame:
    """Whole units in stock per product id, from its highest-revenue variant; unknown stock counts as 0."""
    order = Window.partitionBy("product_id").orderBy(
        F.desc("total_revenue"), "product_name", "category"
    )
    first = performance.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return first.select(
        "product_id", F.coalesce(F.col("current_stock"), F.lit(0.0)).try_cast("long").alias("current_stock")
    )


def product_forecast(
    demand: DataFrame,
    performance: DataFrame,
    horizon_days: int = HORIZON_DAYS,
    window_days: int = WINDOW_DAYS,
    clustered: bool = False,
) -> DataFrame:
    """Forecast per product: recent mean with a capped trend, safety stock, reorder quantity, risk, confidence."""
    if horizon_days <= 0:
        raise ValueError("forecast_horizon_days must be greater than 0.")
    windows = demand_windows(demand, window_days, clustered)
    known = windows.join(stock_by_product(performance), "product_id", "left")
    recent, previous = F.col("recent_avg_daily_demand"), F.col("previous_avg_daily_demand")
    change, stock = F.col("change"), F.col("current_stock")
    predicted, safety = F.col("predicted_demand"), F.col("safety_stock")
    capped = F.greatest(F.least(change, F.lit(TREND_CAP)), F.lit(-TREND_CAP))
    expected = F.greatest(recent * (1 + capped), F.lit(0.0))
    projected = (
        known.withColumns(
            {
                "change": safe_ratio(recent - previous, previous),
                "current_stock": F.coalesce(stock, F.lit(0).cast("long")),
            }
        )
        .withColumns(
            {
                "predicted_demand": half_even_long(expected * horizon_days),
                "safety_stock": half_even_long(F.col("demand_std") * F.sqrt(F.lit(float(horizon_days)))),
                "cover": F.when(recent > 0, stock / recent).otherwise(INF),
                "volatility": finite_or_zero(F.try_divide("demand_std", "avg_daily_demand")),
            }
        )
    )
    return projected.select(
        *PRODUCT_KEYS,
        F.lit(horizon_days).cast("long").alias("forecast_horizon_days"),
        "current_stock",
        F.round("avg_daily_demand", 2).alias("avg_daily_demand"),
        F.round(recent, 2).alias("recent_avg_daily_demand"),
        "predicted_demand",
        "safety_stock",
        F.greatest(predicted + safety - stock, F.lit(0)).alias("recommended_reorder_quantity"),
        trend_class(change).alias("trend_direction"),
        F.round(change, 4).alias("trend_percentage"),
        F.when(F.col("cover") == INF, F.col("cover")).otherwise(F.round("cover", 2)).alias("stock_coverage_days"),
        forecast_risk_class(stock, predicted, safety).alias("forecast_stockout_risk"),
        confidence_class(F.col("history_days"), F.col("volatility")).alias("confidence"),
    )


def by_urgency(forecast: DataFrame) -> DataFrame:
    """Report order of forecasts: risk, then reorder quantity, then product."""
    return forecast.orderBy(
        grade_rank(F.col("forecast_stockout_risk")), F.desc("recommended_reorder_quantity"), "product_id"
    )


def forecast_summary(forecast: DataFrame) -> DataFrame:
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    risk = F.col("forecast_stockout_risk")
    return forecast.agg(
        F.count_distinct("product_id").alias("total_products_forecasted"),
        total("predicted_demand").alias("total_predicted_demand"),
        total("recommended_reorder_quantity").alias("total_recommended_reorder"),
        F.count_if(risk == HIGH).alias("high_forecast_stockout_risk"),
        F.count_if(risk == MEDIUM).alias("medium_forecast_stockout_risk"),
    )
