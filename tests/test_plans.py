"""Whole jobs, and the shape of the physical plans."""

import contextlib
import io
import json

import duckdb
import pytest

import __spark_entry__ as entry_point
import check
from tallyloom.plans import analysis, oracle, registry
from tallyloom.sources.ledger import ledger
from tests.conftest import SF_SMALL


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def result(shop):
    return analysis.analyze(shop)


def test_bundle(result):
    assert list(result.outputs()) == [
        "validation", "summary_metrics", "risk_summary", "forecast_summary", "recommendation_summary",
        "product_performance", "category_performance", "forecast_results", "recommendations",
    ]
    assert result.summary.first().total_revenue == 525.0


def test_bundle_as_json(result, tmp_path):
    result.write_json(str(tmp_path))
    lines = [line for p in tmp_path.glob("product_performance/*.json") for line in p.read_text().splitlines()]
    assert sorted(json.loads(line)["product_name"] for line in lines) == ["Cola 500ml", "Veggie Burger"]


def test_invalid_ledger_yields_only_the_report(text_ledger):
    rejected = analysis.analyze(text_ledger({"closing_stock": "1"}))
    assert list(rejected.outputs()) == ["validation"]
    assert rejected.outputs()["validation"].columns == ["is_valid", "data_quality_score", "errors", "warnings"]


def test_evaluation_run(series, tmp_path, spark):
    run = analysis.evaluate(series([10 + i % 5 for i in range(40)], opening=500), "ledger.csv", 7, 7)
    analysis.write_evaluation(run, str(tmp_path))
    row = spark.read.parquet(f"{tmp_path}/runs").first()
    assert row.run_name == "moving-average-baseline-7d-window" and row.metrics["mae"] == 1.3457
    assert row.params["data_file"] == "ledger.csv" and row.params["recent_window_days"] == "7"
    assert spark.read.csv(f"{tmp_path}/forecast_evaluation_results", header=True).count() == 7


def test_evaluation_needs_a_valid_ledger(text_ledger):
    with pytest.raises(ValueError, match="Data validation failed"):
        analysis.evaluate(text_ledger({"closing_stock": "1"}), "x")


def test_entry_and_registry():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(registry.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", [n for n in registry.queries()])
def test_query_against_sql(spark, name):
    """Same rows as the SQL, and no plan with a cross join, a nested loop or Python code."""
    frame = registry.queries()[name](spark, SF_SMALL)
    plan = plan_of(frame)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert bad not in plan
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert frame.count() > 0
        return
    duck = duckdb.connect()
    for table in ("lineitem", "part", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_SMALL}/{table}.parquet')")
    result = duck.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert check.differences(
        check.rows_of(frame.columns, frame.collect()), check.rows_of(columns, result.fetchall())
    ) == []


def test_only_needed_columns_are_read(spark):
    plan = plan_of(ledger(spark, SF_SMALL).select("date", "sold_quantity"))
    assert "l_extendedprice" not in plan and "p_brand" not in plan and "p_retailprice" not in plan


def test_latest_rows_are_cut_before_the_shuffle(spark):
    assert plan_of(registry.queries()["latest_snapshot"](spark, SF_SMALL)).count("WindowGroupLimit") >= 2
    assert plan_of(registry.queries()["forecast_eval"](spark, SF_SMALL)).count("WindowGroupLimit") >= 2


def test_top_k_is_no_full_sort(spark):
    plan = plan_of(registry.queries()["top_products"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_performance_reads_the_lines_once(spark):
    frame = registry.queries()["product_performance"](spark, SF_SMALL)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet [l_") == 1 and "ReusedExchange" in final
