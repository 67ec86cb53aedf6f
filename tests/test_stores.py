import contextlib
import io
from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import evaluation, forecast, kpi, questions
from tallyloom.plans import analysis, increments, registry
from tallyloom.sources.ledger import ledger
from tests.conftest import SF_SMALL


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def enriched(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("enriched") / "rows")
    kpi.enrich(ledger(spark, SF_SMALL)).write.parquet(path)
    return spark.read.parquet(path)


def same(left, right):
    return rows_of(left.daily.select(*right.daily.columns)) == rows_of(right.daily) and rows_of(left.latest) == rows_of(right.latest)


# ---------------------------------------------------------------- increments


def test_increments_equal_the_whole(spark, enriched, tmp_path):
    """Days, stores and products lie across the increments; undated rows and a retry are among them."""
    undated = enriched.limit(3).withColumn("date", F.lit(None).cast("date"))
    rows = enriched.unionByName(undated).withColumn("part", F.pmod(F.hash("store_id", "date", "product_id"), F.lit(3)))
    for part in (2, 0, 1, 0):
        increments.add_increment(rows.where(F.col("part") == part).drop("part"), str(tmp_path / "store"), f"day{part}")
    whole = kpi.roll_up(rows.drop("part"))
    assert same(increments.stored_rollups(spark, str(tmp_path / "store")), whole)
    increments.compact(spark, str(tmp_path / "store"), str(tmp_path / "base"))
    assert same(increments.stored_rollups(spark, str(tmp_path / "base")), whole)


def test_a_corrected_increment_replaces_its_first_version(spark, enriched, tmp_path):
    folder = str(tmp_path / "store")
    increments.add_increment(enriched.withColumn("sold_quantity", F.lit(1e6)), folder, "a")
    increments.add_increment(enriched, folder, "a")
    assert same(increments.stored_rollups(spark, folder), kpi.roll_up(enriched))


def test_stored_performance_derives_its_ledger_once(spark, tmp_path, monkeypatch):
    """No increment reads order lines or broadcasts parts: what reaches the driver doesn't grow with their number."""
    plans, written = [], []

    def written_once(df, label):
        written.append(label)
        df.write.parquet(str(tmp_path / label))
        return spark.read.parquet(str(tmp_path / label))

    def noted(rows, folder, increment, add=increments.add_increment):
        plans.append(plan_of(rows))
        add(rows, folder, increment)

    monkeypatch.setattr(registry, "settle", written_once)
    monkeypatch.setattr(increments, "add_increment", noted)
    made = registry.queries()["product_performance_stored"](spark, SF_SMALL)
    assert rows_of(made) == rows_of(registry.queries()["product_performance"](spark, SF_SMALL))
    assert written == ["enriched"] and len(plans) == 4
    assert not any("lineitem.parquet" in p or "Broadcast" in p for p in plans)


# ---------------------------------------------------------------- buckets


def test_bucketed_rollup_needs_no_exchange(spark, enriched, tmp_path):
    plain = kpi.daily_rollup(enriched)
    daily = kpi.bucketed(plain, "bucketed_rollup", str(tmp_path / "daily"), 4)
    assert rows_of(daily) == rows_of(plain)
    demand = forecast.daily_demand(daily)
    for got, want in (
        (forecast.demand_windows(demand, clustered=True), forecast.demand_windows(forecast.daily_demand(plain))),
        (forecast.demand_calendar(demand, clustered=True), forecast.demand_calendar(forecast.daily_demand(plain))),
        (evaluation.forecast_eval(evaluation.actual_demand(daily)), evaluation.forecast_eval(evaluation.actual_demand(plain))),
    ):
        assert "Exchange" not in plan_of(got)
        rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]
        assert rows_of(got.select(*rounded)) == rows_of(want.select(*rounded))
    spark.sql("DROP TABLE bucketed_rollup")


# ---------------------------------------------------------------- contexts


def test_context_is_opened_for_the_same_rows_alone(spark, shop, tmp_path, monkeypatch):
    folder = str(tmp_path)
    asked = spark.createDataFrame(
        [("1", "Should I reorder Veggie Burger?"), ("2", "top products"), ("3", "")], "question_id string, question string"
    )
    want = rows_of(analysis.ask(asked, shop))
    assert rows_of(analysis.ask(asked, shop, folder)) == want

    def never(*_):
        raise AssertionError("analysed again")

    monkeypatch.setattr(analysis, "analyze", never)
    assert rows_of(analysis.ask(asked, shop.repartition(3), folder)) == want
    assert rows_of(analysis.ask(asked, shop.select(*reversed(shop.columns)), folder)) == want
    for changed in (shop.withColumn("unit_price", F.col("unit_price") + 1), shop.unionByName(shop.limit(1)), shop.limit(2)):
        with pytest.raises(AssertionError, match="analysed again"):
            analysis.ask(asked, changed, folder)


def test_a_broken_save_is_not_opened(spark, shop, tmp_path):
    result, identity = analysis.analyze(shop), analysis.ledger_identity(shop)
    assert analysis.open_context(spark, str(tmp_path), identity) is None
    result.summary.write.parquet(f"{tmp_path}/{identity}/summary")  # all that an earlier try has left
    assert analysis.open_context(spark, str(tmp_path), identity) is None
    analysis.save_context(result.context(), str(tmp_path), identity)
    opened = analysis.open_context(spark, str(tmp_path), identity)
    for f in fields(questions.Context):
        assert rows_of(getattr(opened, f.name)) == rows_of(getattr(result.context(), f.name))


def test_rejected_ledgers_are_not_saved(spark, text_ledger, tmp_path):
    bad = text_ledger({"closing_stock": "1"})
    asked = spark.createDataFrame([("1", "top products")], "question_id string, question string")
    assert analysis.ask(asked, bad, str(tmp_path)).first().answer == analysis.INVALID_ANSWER
    assert list(tmp_path.iterdir()) == []


# ---------------------------------------------------------------- anchors


def test_anchor_avoids_fragments_of_many_questions(spark):
    """"special" is in one name alone, but in every question; the other fragments are in several names and few questions."""
    names = [("special zebra plum",), *[(f"zebra plum number {i}",) for i in range(5)]]
    named = spark.createDataFrame(names, "lower_name string")
    texts = spark.createDataFrame([(str(i), f"special offer {i}?") for i in range(300)] + [("z", "zebra plum number 3")], "question_id string, text string")
    anchors = {r.lower_name: r.fragment for r in questions._anchored(named, texts).collect()}
    assert anchors["special zebra plum"] not in "special offer"
    counts = questions.fragment_traffic(texts)
    assert counts.count() <= questions.TRAFFIC_SLOTS and counts.agg(F.max("traffic")).first()[0] >= 300
    hits = texts.where(F.contains("text", F.lit(anchors["special zebra plum"]))).count()
    assert hits <= 1
