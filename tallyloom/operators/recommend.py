"""Rule-based recommendations: zero to five rows per product, without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numeric import INF
from tallyloom.functions.rules import HIGH, LOW, MEDIUM, grade_rank, waste_class
from tallyloom.functions.text import days_text, fill, percent_text


@dataclass(frozen=True)
class Rule:
    kind: str
    priority: str
    confidence: str
    action: str
    reason: str


# Recommendation texts, in rule order.
STOCKOUT_HIGH = Rule(
    "Stockout Prevention",
    HIGH,
    HIGH,
    "Increase stock for {name}.",
    "{name} has only {days} of stock left based on average daily demand. This creates a high stockout risk.",
)
STOCKOUT_MEDIUM = Rule(
    "Stock Monitoring",
    MEDIUM,
    MEDIUM,
    "Monitor {name} and prepare reorder if demand continues.",
    "{name} has around {days} of stock left. It is not critical yet, but should be monitored.",
)
OVERSTOCK_HIGH = Rule(
    "Overstock Reduction",
    HIGH,
    HIGH,
    "Reduce future purchase quantity for {name}.",
    "{name} has high overstock risk with {days} of estimated stock coverage. "
    "Excess stock can lock capital and increase holding cost.",
)
OVERSTOCK_MEDIUM = Rule(
    "Overstock Monitoring",
    MEDIUM,
    MEDIUM,
    "Review purchase plan for {name}.",
    "{name} has medium overstock risk with {days} of stock coverage.",
)
WASTE_HIGH = Rule(
    "Waste Reduction",
    HIGH,
    HIGH,
    "Investigate and reduce wastage for {name}.",
    "{name} has a high waste rate of {waste}. "
    "This may indicate over-ordering, expiry issues, poor handling, or demand mismatch.",
)
WASTE_MEDIUM = Rule(
    "Waste Monitoring",
    MEDIUM,
    MEDIUM,
    "Monitor wastage pattern for {name}.",
    "{name} has a moderate waste rate of {waste}. It should be watched before it becomes a larger loss.",
)
HEALTHY = Rule(
    "Maintain Strategy",
    LOW,
    HIGH,
    "Maintain current inventory strategy for {name}.",
    "{name} is performing well with healthy sell-through, low waste, and no major stock risk.",
)
UNHEALTHY = Rule(
    "Product Review",
    HIGH,
    MEDIUM,
    "Review overall inventory strategy for {name}.",
    "{name} has a low product health score of {score}/100. "
    "It may require pricing, purchasing, promotion, or supplier review.",
)
# Thresholds of the last two rules.
GOOD_SELL_THROUGH, GOOD_HEALTH, POOR_HEALTH = 0.30, 80, 60


def _advice(rule: Rule, confidence: Column | None = None) -> Column:
    values = {
        "name": F.col("product_name"),
        "days": days_text(F.col("days_of_stock_left")),
        "waste": percent_text(F.col("waste_rate")),
        "score": F.col("product_health_score").cast("string"),
    }
    return F.struct(
        F.lit(rule.priority).alias("priority"),
        F.lit(rule.kind).alias("recommendation_type"),
        fill(rule.action, **values).alias("action"),
        fill(rule.reason, **values).alias("reason"),
        (F.lit(rule.confidence) if confidence is None else confidence).alias("confidence"),
    )


def _slots() -> list[Column]:
    """One slot per rule group; the members of a group exclude each other."""
    stockout, overstock = F.col("stockout_risk"), F.col("overstock_risk")
    waste, health = waste_class(F.col("waste_rate")), F.col("product_health_score")
    sure = F.when(F.col("avg_daily_demand") > 0, HIGH).otherwise(MEDIUM)
    calm = (
        (stockout == LOW)
        & (overstock == LOW)
        & (waste == LOW)
        & (F.col("sell_through_rate") >= GOOD_SELL_THROUGH)
        & (health >= GOOD_HEALTH)
    )
    return [
        F.when(stockout == HIGH, _advice(STOCKOUT_HIGH, sure)).when(stockout == MEDIUM, _advice(STOCKOUT_MEDIUM)),
        F.when(overstock == HIGH, _advice(OVERSTOCK_HIGH)).when(overstock == MEDIUM, _advice(OVERSTOCK_MEDIUM)),
        F.when(waste == HIGH, _advice(WASTE_HIGH)).when(waste == MEDIUM, _advice(WASTE_MEDIUM)),
        F.when(calm, _advice(HEALTHY)),
        F.when(health < POOR_HEALTH, _advice(UNHEALTHY)),
    ]


def recommendations(performance: DataFrame) -> DataFrame:
    """All recommendations with their supporting metrics; `rule_no` and `total_revenue` carry the report order.

    Endless stock cover has no number: `days_of_stock_left` is NULL there and `days_label` says so.
    """
    days = F.col("days_of_stock_left")
    expanded = performance.select("*", F.posexplode(F.array(*_slots())).alias("rule_no", "advice"))
    return expanded.filter(F.col("advice").isNotNull()).select(
        "product_id",
        F.col("advice.priority").alias("priority"),
        "product_name",
        "category",
        F.col("advice.recommendation_type").alias("recommendation_type"),
        F.col("advice.action").alias("action"),
        F.col("advice.reason").alias("reason"),
        F.col("advice.confidence").alias("confidence"),
        F.coalesce(F.col("current_stock"), F.lit(0.0)).try_cast("long").alias("current_stock"),
        F.round("avg_daily_demand", 2).alias("avg_daily_demand"),
        F.when(days < INF, F.round(days, 2)).alias("days_of_stock_left"),
        F.when(days == INF, F.lit("Not available")).otherwise(F.round(days, 2).cast("string")).alias("days_label"),
        F.round("sell_through_rate", 4).alias("sell_through_rate"),
        F.round("waste_rate", 4).alias("waste_rate"),
        "product_health_score",
        "total_revenue",
        "rule_no",
    )


def priority_order() -> list[Column]:
    """High before Medium before Low, then products by revenue, then rules in order."""
    return [
        grade_rank(F.col("priority")),
        F.desc("total_revenue"),
        F.col("product_id"),
        F.col("product_name"),
        F.col("category"),
        F.col("rule_no"),
    ]


def by_priority(advice: DataFrame) -> DataFrame:
    return advice.orderBy(*priority_order())


def recommendation_summary(advice: DataFrame) -> DataFrame:
    priority = F.col("priority")
    return advice.agg(
        F.count("*").alias("total_recommendations"),
        F.count_if(priority == HIGH).alias("high_priority"),
        F.count_if(priority == MEDIUM).alias("medium_priority"),
        F.count_if(priority == LOW).alias("low_priority"),
    )
