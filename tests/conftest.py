import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyloom.operators import kpi  # noqa: E402
from tallyloom.session import local_session  # noqa: E402
from tallyloom.sources.schema import REQUIRED_COLUMNS  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
LEDGER_TYPES = (
    "date string, store_id string, product_id string, product_name string, category string, opening_stock double, "
    "purchased_quantity double, sold_quantity double, wasted_quantity double, closing_stock double, unit_price double"
)


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def make_ledger(spark):
    """Ledger from tuples in column order; numbers may be ints."""

    def make(rows):
        typed = [(*r[:5], *[None if v is None else float(v) for v in r[5:11]]) for r in rows]
        return spark.createDataFrame(typed, LEDGER_TYPES)

    return make


@pytest.fixture(scope="session")
def text_ledger(spark):
    """Ledger of text columns from dicts that override one valid row."""
    valid = dict(
        zip(
            REQUIRED_COLUMNS,
            ("2025-10-01", "S001", "P001", "Veggie Burger", "Food", "100", "20", "30", "5", "85", "5.99"),
        )
    )

    def make(*overrides):
        rows = [tuple({**valid, **o}[c] for c in REQUIRED_COLUMNS) for o in overrides]
        return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in REQUIRED_COLUMNS))

    return make


@pytest.fixture(scope="session")
def shop(make_ledger):
    return make_ledger(
        [
            ("2025-10-01", "S001", "P001", "Veggie Burger", "Food", 100, 20, 30, 5, 85, 10.0),
            ("2025-10-02", "S001", "P001", "Veggie Burger", "Food", 85, 0, 20, 0, 65, 10.0),
            ("2025-10-01", "S001", "P002", "Cola 500ml", "Beverage", 50, 10, 5, 0, 55, 5.0),
        ]
    )


@pytest.fixture(scope="session")
def rollups_of():
    return lambda ledger: kpi.roll_up(kpi.enrich(ledger))


@pytest.fixture(scope="session")
def rollups(shop, rollups_of):
    return rollups_of(shop)


@pytest.fixture(scope="session")
def series(make_ledger):
    """One product, one store: sold quantity per day offset; None leaves the day out."""

    def make(sold, product="P001", name="Veggie Burger", opening=None, step=5):
        rows = []
        for i, quantity in enumerate(sold):
            if quantity is None:
                continue
            day = (date(2025, 10, 1) + timedelta(days=i)).isoformat()
            stock = 500 - step * i if opening is None else opening
            rows.append((day, "S001", product, name, "Food", stock, 0, quantity, 1, stock - quantity - 1, 5.0))
        return make_ledger(rows)

    return make


def approx(value, digits=6):
    return pytest.approx(value, abs=10**-digits)
