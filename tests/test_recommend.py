import math

import pytest

from tallyloom.operators import ranking, recommend

COLUMNS = (
    "product_id string, product_name string, category string, total_revenue double, total_units_sold double, "
    "total_waste_value double, current_stock double, avg_daily_demand double, days_of_stock_left double, "
    "sell_through_rate double, waste_rate double, stockout_risk string, overstock_risk string, "
    "product_health_score long"
)


@pytest.fixture(scope="module")
def products(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), COLUMNS)

    return make


BURGER = ("P1", "Veggie Burger", "Food", 1000.0, 200.0, 25.0, 20.0, 6.67, 3.0, 0.66, 0.02, "High", "Low", 70)
COLA = ("P2", "Cola 500ml", "Beverage", 500.0, 80.0, 50.0, 500.0, 1.67, 299.4, 0.10, 0.29, "Low", "High", 40)
FRIES = ("P3", "French Fries", "Food", 800.0, 150.0, 5.0, 80.0, 3.33, 24.0, 0.67, 0.02, "Low", "Low", 90)


def kinds(df):
    return [(r.product_id, r.recommendation_type) for r in recommend.by_priority(df).collect()]


def test_rules_of_the_three_products(products):
    advice = recommend.recommendations(products(BURGER, COLA, FRIES))
    assert kinds(advice) == [
        ("P1", "Stockout Prevention"),
        ("P2", "Overstock Reduction"),
        ("P2", "Waste Reduction"),
        ("P2", "Product Review"),
        ("P3", "Maintain Strategy"),
    ]
    assert tuple(recommend.recommendation_summary(advice).first()) == (5, 4, 0, 1)


def test_texts_and_metrics(products):
    row = recommend.recommendations(products(BURGER)).first()
    assert row.action == "Increase stock for Veggie Burger."
    assert row.reason == (
        "Veggie Burger has only 3.0 days of stock left based on average daily demand. "
        "This creates a high stockout risk."
    )
    assert (row.confidence, row.current_stock, row.days_of_stock_left, row.days_label) == ("High", 20, 3.0, "3.0")


def test_middle_grades_and_borders(products):
    def row(**change):
        base = dict(zip([c.split()[0] for c in COLUMNS.split(", ")], FRIES))
        return tuple({**base, **change}.values())

    def of(**change):
        return [k for _, k in kinds(recommend.recommendations(products(row(**change))))]

    assert of(stockout_risk="Medium", days_of_stock_left=10.0) == ["Stock Monitoring"]
    assert of(overstock_risk="Medium", days_of_stock_left=40.0) == ["Overstock Monitoring"]
    assert of(waste_rate=0.05) == ["Maintain Strategy"]
    assert of(waste_rate=0.10) == ["Waste Monitoring"]
    assert of(product_health_score=60, sell_through_rate=0.1) == []
    assert of(product_health_score=59) == ["Product Review"]
    assert of(product_health_score=80, sell_through_rate=0.30) == ["Maintain Strategy"]


def test_endless_cover_and_unknown_stock(products):
    idle = ("P4", "Idle", "X", 0.0, 0.0, 0.0, None, 0.0, math.inf, 0.0, 0.0, "Low", "High", 70)
    row = recommend.recommendations(products(idle)).first()
    assert (row.days_of_stock_left, row.days_label, row.current_stock) == (None, "Not available", 0)
    assert "with Not available of estimated stock coverage" in row.reason


def test_no_demand_lowers_confidence(products):
    odd = ("P5", "Odd", "X", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.5, 0.0, "High", "Low", 75)
    assert recommend.recommendations(products(odd)).first().confidence == "Medium"


def test_rankings(products):
    df = products(BURGER, COLA, FRIES)
    assert [r.product_id for r in ranking.top_products(df, 2).collect()] == ["P1", "P3"]
    assert [r.product_id for r in ranking.top_waste(df, 2).collect()] == ["P2", "P1"]
    assert [r.product_id for r in ranking.stockout_list(df).collect()] == ["P1"]
    assert [r.product_id for r in ranking.overstock_list(df).collect()] == ["P2"]
    advice = recommend.recommendations(df)
    assert ranking.top_recommendations(advice, 2).count() == 2
    assert ranking.top_products(df.limit(0)).count() == 0
    assert ranking.preview(df, 2).count() == 2
    days = df.sparkSession.range(9).selectExpr("date_add(date'2025-10-09', -cast(id as int)) date", "'S' store_id", "id product_id")
    assert [r.product_id for r in ranking.preview(days.repartition(3), 3).collect()] == [8, 7, 6]


def test_insights(products, spark):
    category = spark.createDataFrame([("Food", 1800.0), ("Beverage", 500.0)], "category string, total_revenue double")
    summary = spark.createDataFrame([(57,)], "inventory_health_score long")
    facts = ranking.executive_insights(products(BURGER, COLA, FRIES), category, summary).orderBy("position").collect()
    assert [(f.subject, f.value) for f in facts] == [
        ("Veggie Burger", 1000.0), ("Food", 1800.0), ("Cola 500ml", 50.0), ("inventory", 57.0),
    ]
    assert facts[0].text == "Top revenue product is Veggie Burger, generating $1,000.00 in revenue."
    assert facts[3].text.startswith("Overall inventory health score is 57/100")
