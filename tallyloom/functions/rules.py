"""Business classes and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp

HIGH, MEDIUM, LOW = "High", "Medium", "Low"

# Thresholds of the rule set.
STOCKOUT_DAYS = {HIGH: 7, MEDIUM: 14}
OVERSTOCK_DAYS = {HIGH: 45, MEDIUM: 30}
WASTE_RATES = {HIGH: 0.10, MEDIUM: 0.05}
STOCKOUT_PENALTY = {HIGH: 25, MEDIUM: 12}
OVERSTOCK_PENALTY = {HIGH: 20, MEDIUM: 10}
WASTE_PENALTY = {HIGH: 15, MEDIUM: 7}
WEAK_SELL_THROUGH, WEAK_SELL_THROUGH_PENALTY = 0.20, 10
TREND_STEP = 0.10
CONFIDENCE = {HIGH: (60, 0.40), MEDIUM: (30, 0.75)}
INVENTORY_SELL_THROUGH = {0.30: 15, 0.50: 8}
INVENTORY_WASTE_WEIGHT, INVENTORY_WASTE_CAP = 200, 25
INVENTORY_SHARE_WEIGHTS = {
    "high_stockout_risk_products": 25,
    "high_overstock_risk_products": 20,
    "high_waste_products": 15,
}


def _graded(high: Column, medium: Column) -> Column:
    return F.when(high, F.lit(HIGH)).when(medium, F.lit(MEDIUM)).otherwise(F.lit(LOW))


def _penalty(grade: Column, penalties: dict[str, int]) -> Column:
    expr = F.lit(0)
    for name, points in penalties.items():
        expr = F.when(grade == name, F.lit(points)).otherwise(expr)
    return expr


def stockout_class(days_left: Column) -> Column:
    """Infinite or unknown cover is no stockout risk."""
    return _graded(days_left <= STOCKOUT_DAYS[HIGH], days_left <= STOCKOUT_DAYS[MEDIUM])


def overstock_class(demand: Column, stock: Column, days_left: Column) -> Column:
    idle = (demand == 0) & (stock > 0)
    return _graded(idle | (days_left > OVERSTOCK_DAYS[HIGH]), days_left > OVERSTOCK_DAYS[MEDIUM])


def waste_class(waste_rate: Column) -> Column:
    return _graded(waste_rate > WASTE_RATES[HIGH], waste_rate > WASTE_RATES[MEDIUM])


def product_health(stockout: Column, overstock: Column, waste_rate: Column, sell_through: Column) -> Column:
    lost = (
        _penalty(stockout, STOCKOUT_PENALTY)
        + _penalty(overstock, OVERSTOCK_PENALTY)
        + _penalty(waste_class(waste_rate), WASTE_PENALTY)
        + F.when(sell_through < WEAK_SELL_THROUGH, WEAK_SELL_THROUGH_PENALTY).otherwise(0)
    )
    return clamp(F.lit(100) - lost, 0, 100).cast("long")


def inventory_health(sell_through: Column, waste_rate: Column, products: Column, risk: dict[str, Column]) -> Column:
    """Overall score. Expects the ROUNDED summary rates; every deduction is cut to a whole number."""
    (low, low_points), (fair, fair_points) = INVENTORY_SELL_THROUGH.items()
    score = F.lit(100) - F.when(sell_through < low, low_points).when(sell_through < fair, fair_points).otherwise(0)
    score -= F.least((waste_rate * INVENTORY_WASTE_WEIGHT).cast("long"), F.lit(INVENTORY_WASTE_CAP))
    base = F.greatest(products, F.lit(1))
    for name, weight in INVENTORY_SHARE_WEIGHTS.items():
        score -= (risk[name] / base * weight).cast("long")
    return clamp(score, 0, 100).cast("long")


def trend_class(change: Column) -> Column:
    return F.when(change >= TREND_STEP, "Increasing").when(change <= -TREND_STEP, "Decreasing").otherwise("Stable")


def forecast_risk_class(stock: Column, predicted: Column, safety: Column) -> Column:
    return _graded(stock < predicted, stock < predicted + safety)


def confidence_class(history_days: Column, volatility: Column) -> Column:
    def reached(level: str) -> Column:
        days, spread = CONFIDENCE[level]
        return (history_days >= days) & (volatility <= spread)

    return _graded(reached(HIGH), reached(MEDIUM))


def grade_rank(grade: Column) -> Column:
    """1 for High, 2 for Medium, 3 for Low, 99 for anything else."""
    return F.when(grade == HIGH, 1).when(grade == MEDIUM, 2).when(grade == LOW, 3).otherwise(99)


def at_risk(grade: Column) -> Column:
    return grade.isin(HIGH, MEDIUM)
