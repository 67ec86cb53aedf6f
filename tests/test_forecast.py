import math
from datetime import timedelta

import pytest

from tallyloom.operators import evaluation, forecast, kpi
from tallyloom.sources.files import union_all
from tests.conftest import approx


def demand_of(ledger):
    return forecast.daily_demand(kpi.enrich(ledger))


def forecast_of(ledger, rollups_of, **parameters):
    rollups = rollups_of(ledger)
    return forecast.product_forecast(
        forecast.daily_demand(rollups.daily), kpi.product_performance(rollups), **parameters
    )


STEPS = [10 + i // 10 for i in range(40)]


def test_forecast_of_a_rising_series(series, rollups_of):
    got = forecast_of(series(STEPS), rollups_of).first()
    assert (got.avg_daily_demand, got.recent_avg_daily_demand) == (11.5, 12.71)
    assert (got.trend_percentage, got.trend_direction, got.confidence) == (0.1125, "Increasing", "Medium")
    assert (got.predicted_demand, got.safety_stock, got.current_stock) == (424, 6, 291)
    assert (got.recommended_reorder_quantity, got.forecast_stockout_risk) == (139, "High")
    assert got.stock_coverage_days == 22.89 and got.forecast_horizon_days == 30


def test_short_horizon(series, rollups_of):
    got = forecast_of(series(STEPS), rollups_of, horizon_days=7).first()
    assert (got.predicted_demand, got.safety_stock) == (99, 3)
    assert (got.recommended_reorder_quantity, got.forecast_stockout_risk) == (0, "Low")


def test_windows_must_be_positive(series, rollups_of):
    with pytest.raises(ValueError, match="horizon"):
        forecast_of(series(STEPS), rollups_of, horizon_days=0)
    with pytest.raises(ValueError, match="window"):
        forecast_of(series(STEPS), rollups_of, window_days=0)


def test_demand_needs_its_columns(shop):
    with pytest.raises(ValueError, match="Missing required columns for forecasting"):
        forecast.daily_demand(shop.drop("sold_quantity"))
    with pytest.raises(ValueError, match="Missing required columns for forecast evaluation"):
        evaluation.actual_demand(shop.drop("sold_quantity"))


def brute_force(sold, window):
    """Means and spread over the dense list of days."""
    days = [0 if q is None else q for q in sold]
    n, mean = len(days), sum(days) / len(days)
    recent, both = days[-window:], days[-2 * window:]
    previous = both[:window]
    spread = math.sqrt(sum((q - mean) ** 2 for q in days) / n)
    return n, mean, sum(recent) / len(recent), sum(previous) / len(previous), spread


HISTORIES = [
    STEPS,
    list(range(20)),  # previous window overlaps the recent one
    list(range(28)),
    list(range(14)),  # both windows are the whole history
    [5],
    [7, 3],
    [4] + [None] * 30 + [9],
    [3, None, None, 8, None, 2] * 9 + [1],
    [1] + [None] * 20 + [6] + [None] * 15 + [2],
    [0] * 31,
]


@pytest.mark.parametrize("window", [3, 14])
def test_windows_match_brute_force(series, window):
    ledgers = [series(sold, product=f"P{i}") for i, sold in enumerate(HISTORIES)]
    got = {r.product_id: r for r in forecast.demand_windows(demand_of(union_all(ledgers)), window).collect()}
    for i, sold in enumerate(HISTORIES):
        n, mean, recent, previous, spread = brute_force(sold, window)
        row = got[f"P{i}"]
        assert row.history_days == n
        assert row.avg_daily_demand == approx(mean, 9) and row.demand_std == approx(spread, 9)
        assert row.recent_avg_daily_demand == approx(recent, 9)
        assert row.previous_avg_daily_demand == approx(previous, 9)


def test_calendar_is_dense_and_idempotent(series, spark):
    dense = forecast.demand_calendar(demand_of(series([4, None, None, 9, None, 1])))
    rows = dense.orderBy("date").collect()
    assert [r.sold_quantity for r in rows] == [4, 0, 0, 9, 0, 1]
    assert {b.date - a.date for a, b in zip(rows, rows[1:])} == {timedelta(days=1)}
    again = forecast.demand_calendar(dense)
    assert again.orderBy("date").collect() == rows


def test_calendar_carries_the_name_of_the_day_before(make_ledger, rollups_of):
    df = make_ledger(
        [
            ("2025-10-01", "S1", "P", "Old", "X", 9, 0, 1, 0, 8, 1),
            ("2025-10-03", "S1", "P", "New", "X", 8, 0, 2, 0, 6, 1),
        ]
    )
    rows = forecast.demand_calendar(demand_of(df)).orderBy("date").collect()
    assert [(r.product_name, r.sold_quantity) for r in rows] == [("Old", 1), ("Old", 0), ("New", 2)]
    got = forecast_of(df, rollups_of).first()
    assert got.product_name == "Old" and got.current_stock == 6


def test_two_names_on_one_day_are_summed(make_ledger, rollups_of):
    df = make_ledger(
        [
            ("2025-10-01", "S1", "P", "Tea", "X", 9, 0, 1, 0, 8, 1),
            ("2025-10-01", "S2", "P", "Chai", "X", 9, 0, 4, 0, 5, 1),
            ("2025-10-02", "S1", "P", "Tea", "X", 8, 0, 3, 0, 5, 1),
        ]
    )
    got = forecast_of(df, rollups_of).first()
    assert got.avg_daily_demand == 4.0 and got.product_name == "Chai"


def test_no_recent_demand(series, rollups_of):
    got = forecast_of(series([8] * 5 + [0] * 40, opening=50), rollups_of).first()
    assert got.stock_coverage_days == math.inf and got.predicted_demand == 0
    assert (got.trend_direction, got.trend_percentage) == ("Stable", 0)


def test_half_even_rounding(series, rollups_of):
    assert forecast_of(series([1, 4]), rollups_of, horizon_days=1).first().predicted_demand == 2
    assert forecast_of(series([3, 4]), rollups_of, horizon_days=1).first().predicted_demand == 4


def test_summary_and_order(series, rollups_of, spark):
    both = series(STEPS).unionByName(series([1] * 40, product="P002", name="Cola", opening=900, step=0))
    result = forecast_of(both, rollups_of)
    assert [r.product_id for r in forecast.by_urgency(result).collect()] == ["P001", "P002"]
    assert tuple(forecast.forecast_summary(result).first()) == (2, 424 + 30, 139, 1, 0)
    assert tuple(forecast.forecast_summary(result.limit(0)).first()) == (0, 0, 0, 0, 0)


# ---------------------------------------------------------------- evaluation


def evaluation_of(ledger, window=7, test=7):
    return evaluation.forecast_eval(evaluation.actual_demand(kpi.enrich(ledger)), window, test)


def test_evaluation(series):
    rows = evaluation_of(series([10 + i % 5 for i in range(40)]))
    assert rows.count() == 7 and {r.predicted_demand for r in rows.collect()} == {11.86}
    assert tuple(evaluation.forecast_metrics(rows).first()) == (1.3457, 1.5108, 10.8135, 1)


def test_evaluation_needs_one_row_more_than_both_windows(series):
    assert evaluation_of(series([1] * 14)).count() == 0
    assert evaluation_of(series([1] * 15)).count() == 7
    assert tuple(evaluation.forecast_metrics(evaluation_of(series([1] * 14))).first()) == (0, 0, 0, 0)


def test_evaluation_counts_selling_days(series):
    rows = evaluation_of(series([2, None] * 15), 7, 7)
    assert rows.count() == 7 and rows.first().predicted_demand == 2.0


def test_zero_actuals_stay_out_of_mape(series):
    got = evaluation.forecast_metrics(evaluation_of(series([2] * 8 + [0] * 7))).first()
    assert (got.mae, got.rmse, got.mape) == (2.0, 2.0, 0.0)


def test_evaluation_windows_must_be_positive(series):
    for window, test in ((0, 7), (7, 0)):
        with pytest.raises(ValueError, match="must be greater than 0"):
            evaluation_of(series([1] * 20), window, test)
