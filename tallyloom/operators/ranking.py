"""Top-k lists, risk lists, insights and the column choices of the report tables.

Every sort ends in the product keys, so equal values come out in one order. A top-k is a sort with a limit, which
Spark runs as a per-task top-k without sorting the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.rules import at_risk, grade_rank
from tallyloom.functions.text import fill, money_text
from tallyloom.operators.recommend import by_priority
from tallyloom.sources.files import union_all
from tallyloom.sources.schema import PRODUCT_KEYS

TOP = 5
CHART_TOP = 8
BRIEF_TOP = 10
PREVIEW_ROWS = 50

# Columns of the report tables.
PRODUCT_TABLE = (
    "product_name", "category", "total_revenue", "total_units_sold", "total_units_wasted", "current_stock",
    "sell_through_rate", "waste_rate", "stockout_risk", "overstock_risk", "product_health_score",
)
CATEGORY_TABLE = (
    "category", "total_revenue", "total_units_sold", "total_units_wasted", "total_waste_value", "product_count",
    "sell_through_rate", "waste_rate",
)
FORECAST_TABLE = (
    "product_name", "category", "current_stock", "avg_daily_demand", "recent_avg_daily_demand", "predicted_demand",
    "safety_stock", "recommended_reorder_quantity", "trend_direction", "forecast_stockout_risk", "confidence",
)
RECOMMENDATION_TABLE = (
    "priority", "product_name", "category", "recommendation_type", "action", "reason", "confidence",
    "current_stock", "avg_daily_demand", "days_of_stock_left", "product_health_score",
)
STOCKOUT_TABLE = (
    "product_name", "category", "current_stock", "avg_daily_demand", "days_of_stock_left", "stockout_risk",
)
OVERSTOCK_TABLE = (
    "product_name", "category", "current_stock", "avg_daily_demand", "days_of_stock_left", "overstock_risk",
)
PRODUCT_BRIEF = (
    "product_name", "category", "total_revenue", "total_units_sold", "current_stock", "stockout_risk",
    "overstock_risk", "product_health_score",
)
FORECAST_BRIEF = (
    "product_name", "category", "current_stock", "predicted_demand", "safety_stock", "recommended_reorder_quantity",
    "trend_direction", "forecast_stockout_risk", "confidence",
)
RECOMMENDATION_BRIEF = ("priority", "product_name", "recommendation_type", "action", "confidence")


def top_products(performance: DataFrame, k: int = TOP) -> DataFrame:
    return performance.orderBy(F.desc("total_revenue"), *PRODUCT_KEYS).limit(k)


def top_waste(performance: DataFrame, k: int = TOP) -> DataFrame:
    return performance.orderBy(F.desc("total_waste_value"), *PRODUCT_KEYS).limit(k)


def top_reorder(forecast: DataFrame, k: int = CHART_TOP) -> DataFrame:
    return forecast.orderBy(F.desc("recommended_reorder_quantity"), "product_id").limit(k)


def top_recommendations(advice: DataFrame, k: int = TOP) -> DataFrame:
    return by_priority(advice).limit(k)


def stockout_list(performance: DataFrame) -> DataFrame:
    """Products that may run out: High first, least cover first."""
    listed = performance.filter(at_risk(F.col("stockout_risk")))
    return listed.orderBy(grade_rank(F.col("stockout_risk")), "days_of_stock_left", *PRODUCT_KEYS)


def overstock_list(performance: DataFrame) -> DataFrame:
    """Products with too much stock: High first, longest cover first."""
    listed = performance.filter(at_risk(F.col("overstock_risk")))
    return listed.orderBy(grade_rank(F.col("overstock_risk")), F.desc("days_of_stock_left"), *PRODUCT_KEYS)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by date, store and product, as far as df has these; a top-k per task and one merge of those."""
    order = [c for c in ("date", "store_id", "product_id") if c in df.columns]
    return df.orderBy(*order).limit(rows) if order else df.limit(rows)


def executive_insights(performance: DataFrame, category: DataFrame, summary: DataFrame) -> DataFrame:
    """Four facts: top product, best category, highest waste, health. One aggregate per input, no sort."""

    def leader(measure: str, *ties: str) -> Column:
        place = F.struct((-F.col(measure)).alias("place"), *ties)
        return F.min_by(F.struct(F.col(ties[-1]).alias("subject"), F.col(measure).alias("value")), place)

    # Wording of the insights.
    texts = {
        "top_product": "Top revenue product is {subject}, generating {money} in revenue.",
        "best_category": "Best-performing category is {subject}, with {money} total revenue.",
        "highest_waste": "Highest waste value is from {subject}, causing an estimated loss of {money}.",
        "inventory_health": "Overall inventory health score is {score}/100, based on sell-through, waste, "
        "stockout, and overstock risk.",
    }
    names = list(texts)
    product_ties = ("product_id", "category", "product_name")
    products = performance.agg(
        leader("total_revenue", *product_ties).alias(names[0]),
        leader("total_waste_value", *product_ties).alias(names[2]),
    )
    best = category.agg(leader("total_revenue", "category").alias(names[1]))
    health = summary.select(
        F.struct(F.lit("inventory").alias("subject"), F.col("inventory_health_score").cast("double").alias("value"))
        .alias(names[3])
    )
    facts = [
        frame.select(F.lit(names.index(c) + 1).cast("long").alias("position"), F.lit(c).alias("insight"), f"{c}.*")
        for frame in (products, best, health)
        for c in frame.columns
    ]
    text = F.lit(None).cast("string")
    for name, template in texts.items():
        filled = fill(
            template,
            subject=F.col("subject"),
            money=money_text(F.col("value")),
            score=F.col("value").cast("long").cast("string"),
        )
        text = F.when(F.col("insight") == name, filled).otherwise(text)
    return union_all(facts).withColumn("text", text)
