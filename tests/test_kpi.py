import math

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import kpi
from tests.conftest import approx


def by_name(df):
    return {r.product_name: r for r in df.collect()}


def test_enriched_columns(shop):
    got = kpi.enrich(shop).filter("product_id = 'P001' and date = '2025-10-01'").first()
    assert (got.available_stock, got.revenue, got.waste_value, got.closing_inventory_value) == (120, 300, 50, 850)
    assert got.average_inventory == 92.5
    assert got.sell_through_rate == approx(0.25) and got.waste_rate == approx(5 / 35)
    assert got.stock_turnover == approx(30 / 92.5)


def test_enrich_needs_its_columns(shop):
    with pytest.raises(ValueError, match="Missing required columns for KPI calculation"):
        kpi.enrich(shop.drop("category"))


def test_enrich_fills_bad_numbers_and_guards_ratios(text_ledger):
    got = kpi.enrich(text_ledger({"opening_stock": "?", "purchased_quantity": None, "sold_quantity": "3"})).first()
    assert got.opening_stock == 0 and got.sell_through_rate == 0 and got.available_stock == 0


def test_summary(rollups):
    got = kpi.summary_metrics(rollups, kpi.product_performance(rollups)).first()
    assert (got.total_revenue, got.total_units_sold, got.total_units_wasted, got.total_waste_value) == (525, 55, 5, 50)
    assert got.latest_inventory_value == 925
    assert (got.date_start, got.date_end, got.unique_stores, got.unique_products) == ("2025-10-01", "2025-10-02", 1, 2)
    assert (got.average_sell_through_rate, got.average_waste_rate) == (0.2075, 0.0833)
    assert got.inventory_health_score == 57


def test_performance(rollups):
    got = by_name(kpi.product_performance(rollups))
    burger, cola = got["Veggie Burger"], got["Cola 500ml"]
    assert (burger.days_of_stock_left, burger.stockout_risk, burger.overstock_risk) == (2.6, "High", "Low")
    assert burger.sell_through_rate == approx(0.243902) and burger.waste_rate == approx(0.090909)
    assert (burger.product_health_score, burger.active_days, burger.current_stock) == (68, 2, 65)
    assert (cola.days_of_stock_left, cola.stockout_risk, cola.product_health_score) == (11.0, "Medium", 78)
    assert cola.sell_through_rate == approx(0.083333) and cola.waste_rate == 0


def test_category_and_risk(rollups):
    rows = kpi.by_revenue(kpi.category_performance(rollups)).collect()
    assert [(r.category, r.total_revenue, r.product_count) for r in rows] == [("Food", 500, 1), ("Beverage", 25, 1)]
    risk = kpi.risk_summary(kpi.product_performance(rollups))
    assert tuple(risk.first()) == (1, 1, 0, 0, 0)
    assert kpi.high_risk_products(risk).first()[0] == 1


def test_category_revenue_is_product_revenue(rollups):
    products = kpi.product_performance(rollups).agg(F.sum("total_revenue")).first()[0]
    assert kpi.category_performance(rollups).agg(F.sum("total_revenue")).first()[0] == products
    assert kpi.daily_revenue(rollups).agg(F.sum("revenue")).first()[0] == products


def test_row_order_changes_nothing(shop, rollups, rollups_of):
    turned = rollups_of(shop.orderBy(F.desc("date"), "product_id"))
    assert by_name(kpi.product_performance(turned)) == by_name(kpi.product_performance(rollups))


def test_stock_is_summed_over_stores_and_latest_day_wins(make_ledger, rollups_of):
    rollups = rollups_of(
        make_ledger(
            [
                ("2025-10-01", "S1", "P", "Tea", "Drink", 0, 9, 1, 0, 8, 2),
                ("2025-10-03", "S1", "P", "Tea", "Drink", 8, 0, 1, 0, 7, 2),
                ("2025-10-02", "S1", "P", "Tea", "Drink", 8, 0, 0, 0, 8, 2),
                ("2025-10-01", "S2", "P", "Tea", "Drink", 0, 5, 0, 0, 5, 2),
            ]
        )
    )
    assert kpi.latest_stock(rollups).first().current_stock == 12
    assert kpi.product_performance(rollups).first().active_days == 3


def test_missing_date_is_the_latest(make_ledger, rollups_of):
    rollups = rollups_of(
        make_ledger(
            [
                ("2025-10-09", "S1", "P", "Tea", "Drink", 0, 9, 1, 0, 8, 2),
                (None, "S1", "P", "Tea", "Drink", 8, 0, 4, 0, 4, 2),
            ]
        )
    )
    got = kpi.product_performance(rollups).first()
    assert (got.current_stock, got.active_days, got.total_units_sold) == (4, 1, 5)
    assert kpi.daily_revenue(rollups).count() == 1


def test_ties_are_broken_the_same_way(make_ledger):
    rows = [("2025-10-01", "S1", "P", "Tea", "Drink", 0, i, 0, 0, i, 2) for i in range(20)]
    for order in (rows, rows[::-1]):
        enriched = kpi.enrich(make_ledger(order)).repartition(4)
        assert [r.closing_stock for r in kpi.latest_snapshot(enriched).collect()] == [19]


def test_renamed_product_has_no_stock_under_its_old_name(make_ledger, rollups_of):
    rollups = rollups_of(
        make_ledger(
            [
                ("2025-10-01", "S1", "P", "Tea", "Drink", 0, 9, 1, 0, 8, 2),
                ("2025-10-02", "S1", "P", "Green Tea", "Drink", 8, 0, 4, 0, 4, 2),
            ]
        )
    )
    got = by_name(kpi.product_performance(rollups))
    assert got["Tea"].current_stock is None and got["Tea"].days_of_stock_left is None
    assert (got["Tea"].stockout_risk, got["Tea"].overstock_risk) == ("Low", "Low")
    assert got["Green Tea"].current_stock == 4


def test_zero_demand(make_ledger, rollups_of):
    rollups = rollups_of(
        make_ledger(
            [
                ("2025-10-01", "S1", "P1", "Empty", "X", 0, 0, 0, 0, 0, 2),
                ("2025-10-01", "S1", "P2", "Idle", "X", 9, 0, 0, 0, 9, 2),
            ]
        )
    )
    for row in kpi.product_performance(rollups).collect():
        assert row.days_of_stock_left == math.inf
        assert (row.stockout_risk, row.overstock_risk) == ("Low", "High")


def test_missing_keys_form_no_group_but_count_in_the_summary(make_ledger, rollups_of):
    rollups = rollups_of(
        make_ledger(
            [
                ("2025-10-01", "S1", "P1", "Tea", "Drink", 0, 9, 1, 0, 8, 2),
                ("2025-10-01", "S2", "P2", None, "Drink", 0, 9, 2, 0, 7, 2),
                ("2025-10-01", "S3", None, "Ice", None, 0, 9, 3, 0, 6, 2),
            ]
        )
    )
    performance = kpi.product_performance(rollups)
    assert list(by_name(performance)) == ["Tea"]
    assert [(r.category, r.total_units_sold, r.product_count) for r in kpi.category_performance(rollups).collect()] == [
        ("Drink", 3, 2)
    ]
    got = kpi.summary_metrics(rollups, performance).first()
    assert (got.total_units_sold, got.unique_stores, got.unique_products) == (6, 3, 2)
    assert got.latest_inventory_value == 42


def test_money_is_exact_and_keeps_infinite_values(make_ledger, rollups_of):
    cents = [("2025-10-01", f"S{i}", "P", "Tea", "Drink", 1, 0, 1, 0, 0, 0.1) for i in range(1000)]
    assert kpi.product_performance(rollups_of(make_ledger(cents))).first().total_revenue == 100.0
    endless = [("2025-10-01", "S1", "P", "Tea", "Drink", 1, 0, 1, 0, 0, math.inf)]
    assert kpi.product_performance(rollups_of(make_ledger(cents + endless))).first().total_revenue == math.inf
