import pytest
from pyspark.sql import functions as F

from tallyloom.functions.numeric import DAY_LAYOUTS, parse_day, parse_layout, parse_number
from tallyloom.operators import quality
from tallyloom.sources.ledger import dirty_ledger
from tallyloom.sources.schema import day_layout
from tests.conftest import SF_SMALL


def report(df):
    return quality.validate(df).report.first()


def test_valid_row_scores_full(text_ledger):
    got = report(text_ledger({}))
    assert (got.is_valid, got.data_quality_score, got.errors, got.warnings) == (True, 100, [], [])
    assert got.row_count == 1 and len(got.columns) == 11


def test_title_case_headers_are_valid(text_ledger):
    df = text_ledger({})
    titled = df.toDF(*[c.replace("_", " ").title() for c in df.columns])
    assert report(titled).is_valid


def test_missing_columns_stop_everything(spark):
    got = report(spark.createDataFrame([("2025-10-01", "S001", "P001", "x")] * 2, "date string, store_id string, product_id string, product_name string"))
    assert not got.is_valid and got.data_quality_score == 70 and got.row_count == 2
    assert got.errors[0].startswith("Missing required columns: ['category', 'opening_stock'")
    assert len(got.errors) == 1 and got.warnings == []


@pytest.mark.parametrize(
    "change, errors, score",
    [
        ({"opening_stock": "-100", "closing_stock": "-115"},
         ["Column 'opening_stock' has 1 negative values.", "Column 'closing_stock' has 1 negative values.",
          "Found 1 rows where sold quantity is greater than available stock."], 94),
        ({"closing_stock": "999"}, ["Found 1 rows where closing stock does not match inventory equation."], 99),
        ({"date": "soon"}, ["Found 1 rows with invalid dates.", "Found 1 missing values in required columns."], 97),
        ({"sold_quantity": "abc"},
         ["Column 'sold_quantity' has 1 invalid numeric values.", "Found 1 missing values in required columns.",
          "Found 1 rows where closing stock does not match inventory equation."], 96),
        ({"product_name": "  "}, ["Found 1 rows with empty product names."], 98),
        ({"product_name": None}, ["Found 1 missing values in required columns."], 99),
    ],
)
def test_each_error_costs_its_points(text_ledger, change, errors, score):
    got = report(text_ledger(change))
    assert got.errors == errors and got.data_quality_score == score and not got.is_valid


def test_caps_and_floor(text_ledger):
    got = report(text_ledger(*[{"closing_stock": str(900 + i)} for i in range(40)]))
    assert got.data_quality_score == 75
    bad = {"date": "x", "opening_stock": "?", "purchased_quantity": "?", "sold_quantity": "?", "product_name": " "}
    assert report(text_ledger(*[bad] * 40)).data_quality_score == 0


def test_warnings_keep_the_ledger_valid(text_ledger):
    rows = [{"wasted_quantity": "6", "closing_stock": "84"}] * 3
    got = report(text_ledger(*rows))
    assert got.is_valid and got.data_quality_score == 95
    assert got.warnings == ["Found 2 duplicate rows.", "Found 3 rows with wastage rate above 25%."]


def test_no_purchase_is_no_high_waste(text_ledger):
    assert report(text_ledger({"purchased_quantity": "0", "closing_stock": "65"})).warnings == []


def test_outliers_need_spread(text_ledger):
    rows = [{"opening_stock": "1000", "sold_quantity": str(10 + i % 2), "closing_stock": str(1005 - i % 2),
             "store_id": f"S{i:03}"} for i in range(30)]
    assert report(text_ledger(*rows)).warnings == []
    spike = {"opening_stock": "1000", "sold_quantity": "500", "closing_stock": "515"}
    assert report(text_ledger(*rows, spike)).warnings == ["Found 1 possible sales outliers."]


def test_duplicates_compare_nulls_and_extra_columns(text_ledger):
    df = text_ledger({"category": None}, {"category": None}, {}, {}, {}, {"store_id": "S9"})
    assert quality.duplicate_rows(df).first()[0] == 3
    assert quality.duplicate_rows(df.withColumn("extra", F.monotonically_increasing_id())).first()[0] == 0


def test_duplicates_are_exact_on_either_join(text_ledger, monkeypatch):
    df = text_ledger(*[{"store_id": f"S{i % 7}"} for i in range(50)])
    assert quality.duplicate_rows(df).first()[0] == 43
    monkeypatch.setattr(quality, "fits_broadcast", lambda frame: False)
    assert quality.duplicate_rows(df).first()[0] == 43


def test_dirty_ledger_counts(spark):
    counts = quality.all_counts(dirty_ledger(spark, SF_SMALL)).first()
    names = ("bad_date", "bad_sold_quantity", "negative_wasted_quantity", "empty_names", "equation_breaks",
             "impossible_sales", "duplicate_rows", "high_waste_rows", "sales_outliers")
    assert [counts[n] for n in names] == [180, 70, 45, 181, 339, 40, 60, 2, 35]
    assert counts.row_count == 6020


def test_number_and_date_text(spark):
    numbers = {"1,000": None, "0x10": None, "": None, " 2 ": 2.0, "1e3": 1000.0, "1d": None, "nan": None, "-.5": -0.5,
               "inf": float("inf"), "5.": 5.0, "abc": None, None: None}
    df = spark.createDataFrame([(k,) for k in numbers], "t string")
    got = df.select("t", parse_number(F.col("t"), df.schema["t"].dataType).alias("n")).collect()
    assert {r.t: r.n for r in got} == numbers
    days = {"2025-10-01": "2025-10-01", "2025-1-5": "2025-01-05", "2025/10/01": "2025-10-01",
            "10/02/2025": "2025-10-02", "2025-10-01 13:05:00": "2025-10-01", "2025-10-01T23:59:59.25": "2025-10-01",
            "2025-13-01": None, "2025-10-01 junk": None, "soon": None, "2025": None, None: None}
    df = spark.createDataFrame([(k,) for k in days], "t string")
    got = df.select("t", parse_day(F.col("t"), df.schema["t"].dataType).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in got} == days


@pytest.mark.parametrize("cells, layout, days", [
    (["2025-10-01 08:30", "2025-10-2T00:00:00Z", "2025-10-03T23:59:59.25+14:00", "04-Oct-2025"], "yyyy-M-d", "1 2 3 -"),
    (["13/10/2025", "14/10/2025", "10/13/2025"], "d/M/yyyy", "13 14 -"),
    (["10/1/2025 8:30 AM", "10/13/2025", "13/10/2025"], "M/d/yyyy", "1 13 -"),
    (["1/10/2025", None, ""], "M/d/yyyy", "10 - -"),
    (["01-Oct-2025", " 2-oct-2025 ", "2025-10-03"], "d-MMM-yyyy", "1 2 -"),
    (["October 1, 2025", "May 2, 2025"], "MMMM d, yyyy", "1 2"),
    (["20251001", "20251302", "20251003 25:00"], "yyyyMMdd", "1 - -"),
    (["31.12.2025", "31.2.2025"], "d.M.yyyy", "31 -"),
    (["x", None], None, "- -"),
])
def test_dates_follow_the_layout_of_most_cells(spark, text_ledger, cells, layout, days):
    df = text_ledger(*[{"date": c} for c in cells])
    assert day_layout(df) == layout
    read = df.select(F.day(parse_layout(F.col("date"), layout or DAY_LAYOUTS[0])).alias("d")).collect()
    assert " ".join("-" if r.d is None else str(r.d) for r in read) == days


def test_cells_in_another_layout_are_invalid_dates(text_ledger):
    mixed = text_ledger({"date": "13/10/2025"}, {"date": "14/10/2025 10:00"}, {"date": "2025-10-15"})
    assert report(mixed).errors[0] == "Found 1 rows with invalid dates."
    assert report(text_ledger({"date": "1-Oct-2025"}, {"date": "02-Oct-2025"})).is_valid
