import pytest

from tallyloom.operators import kpi, questions, recommend
from tallyloom.plans import analysis

PERFORMANCE = (
    "product_id string, product_name string, category string, total_revenue double, total_units_sold double, "
    "total_units_wasted double, total_waste_value double, current_stock double, avg_daily_demand double, "
    "days_of_stock_left double, sell_through_rate double, waste_rate double, stockout_risk string, "
    "overstock_risk string, product_health_score long"
)
ROWS = [
    ("P001", "Veggie Burger", "Food", 1000.0, 200.0, 5.0, 25.0, 20.0, 6.5, 3.0, 0.66, 0.02, "High", "Low", 75),
    ("P002", "Cola 500ml", "Beverage", 500.0, 80.0, 20.0, 50.0, 500.0, 2.0, 250.0, 0.20, 0.20, "Low", "High", 45),
]


@pytest.fixture(scope="module")
def context(spark):
    performance = spark.createDataFrame(ROWS, PERFORMANCE)
    return questions.Context(
        summary=spark.createDataFrame(
            [(78, 1500.0, 280, 75.0)],
            "inventory_health_score long, total_revenue double, total_units_sold long, total_waste_value double",
        ),
        risk=kpi.risk_summary(performance),
        performance=performance,
        category=spark.createDataFrame(
            [("Food", 1000.0, 200.0), ("Beverage", 500.0, 80.0)],
            "category string, total_revenue double, total_units_sold double",
        ),
        advice=recommend.recommendations(performance),
        forecast=spark.createDataFrame(
            [("P001", "Veggie Burger", 190, 20, 190, "High", "Medium"), ("P002", "Cola 500ml", 60, 10, 0, "Low", "Medium")],
            "product_id string, product_name string, predicted_demand long, safety_stock long, "
            "recommended_reorder_quantity long, forecast_stockout_risk string, confidence string",
        ),
        forecast_totals=spark.createDataFrame(
            [(2, 1250, 190, 1)],
            "total_products_forecasted long, total_predicted_demand long, total_recommended_reorder long, "
            "high_forecast_stockout_risk long",
        ),
    )


def asked(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "question_id string, question string")


INTENTS = {
    "Give me inventory summary": "inventory_summary",
    "Which are the top products?": "top_products",
    "Which products are at stockout risk?": "stockout_risk",
    "Should I reorder Veggie Burger next month?": "product_recommendation",
    "should i REORDER vegGIE burgers": "product_recommendation",
    "Which product has highest waste?": "waste_analysis",
    "": "empty_question",
    " \n\t": "empty_question",
    "category performance": "inventory_summary",
    "Has it stopped?": "top_products",
    "Any excess?": "overstock_risk",
    "What about next week?": "forecast_summary",
    "what should i do": "general_recommendations",
    "List the categories": "category_performance",
    "Hello": "inventory_summary",
    "Tell me about Cola 500ml": "inventory_summary",
    "Should I order something?": "inventory_summary",
    "recommend something": "general_recommendations",
}


@pytest.fixture(scope="module")
def answered(spark, context):
    texts = list(INTENTS)
    return {texts[int(r.question_id)]: r for r in questions.answers(asked(spark, texts), context).collect()}


def test_intents(answered):
    assert {q: r.intent for q, r in answered.items()} == INTENTS


def test_envelope(answered):
    empty = answered[""]
    assert (empty.confidence, empty.tools_used) == ("Low", []) and empty.answer == questions.EMPTY_ANSWER
    top = answered["Which are the top products?"]
    assert (top.confidence, top.tools_used) == ("High", ["top_products"])
    assert top.answer == (
        "Here are the strongest products based on revenue performance.\n\nTop products by revenue:\n\n"
        "1. Veggie Burger generated $1,000.00 from 200 units sold.\n"
        "2. Cola 500ml generated $500.00 from 80 units sold."
    )


def test_sentences(answered):
    assert answered["Hello"].answer.endswith(
        "Inventory health score is 78/100. Total revenue is $1,500.00, units sold are 280, and waste value is $75.00. "
        "There are 1 high stockout-risk products and 1 high overstock-risk products."
    )
    assert "Total predicted demand is 1,250 units." in answered["What about next week?"].answer
    assert answered["Which products are at stockout risk?"].answer.endswith(
        "- Veggie Burger has High stockout risk with approximately 3.0 days of stock left."
    )
    assert "- Cola 500ml has waste value of $50.00 and waste rate of 20.0%." in answered[
        "Which product has highest waste?"
    ].answer


def test_product_answer(answered):
    got = answered["Should I reorder Veggie Burger next month?"]
    assert got.product_name == "Veggie Burger" and got.confidence == "High"
    assert got.answer == (
        "I checked this product using KPIs, forecast, and recommendation rules.\n\n"
        "Product analysis for Veggie Burger:\n- Current stock: 20\n- Stockout risk: High\n- Overstock risk: Low\n"
        "- Waste rate: 2.0%\n- Product health score: 75/100\n- Predicted 30-day demand: 190\n- Safety stock: 20\n"
        "- Recommended reorder quantity: 190\n- Forecast stockout risk: High\n- Forecast confidence: Medium\n\n"
        "Recommended actions:\n- [High] Increase stock for Veggie Burger. Reason: Veggie Burger has only 3.0 days of "
        "stock left based on average daily demand. This creates a high stockout risk."
    )


def test_empty_results(spark, context):
    none = questions.Context(
        context.summary, context.risk, context.performance.limit(0), context.category.limit(0),
        context.advice.limit(0), context.forecast.limit(0), context.forecast_totals,
    )
    got = {r.intent: r for r in questions.answers(asked(spark, ["top", "stockout", "waste", "what action"]), none).collect()}
    assert got["top_products"].answer == "I could not complete the analysis. No product data is available."
    assert got["top_products"].confidence == "Low" and got["waste_analysis"].confidence == "Low"
    assert got["stockout_risk"].answer.endswith("No high or medium stockout-risk products were detected.")
    assert got["general_recommendations"].confidence == "High"


@pytest.mark.parametrize("count", [199, 200, 201, 1000])
def test_long_lists_come_in_numbered_parts(spark, context, count):
    category = spark.range(count).selectExpr("concat('C', id) category", "double(1000000 - id) total_revenue", "double(1) total_units_sold")
    long = questions.Context(
        context.summary, context.risk, context.performance, category, context.advice, context.forecast, context.forecast_totals
    )
    rows = [r for r in questions.answers(asked(spark, ["category", "top"]), long).collect() if r.intent == "category_performance"]
    rows.sort(key=lambda r: r.part)
    parts = -(-count // 200)
    assert [(r.part, r.parts) for r in rows] == [(i + 1, parts) for i in range(parts)]
    lines = [line for r in rows for line in r.answer.split("\n") if line.startswith("- ")]
    assert [line.split()[1] for line in lines] == [f"C{i}" for i in range(count)]
    assert all(r.answer.count("\n- ") <= 200 and (f"(part {r.part} of {parts})" in r.answer) == (parts > 1) for r in rows)


def test_long_advice_comes_in_numbered_parts(spark, context, monkeypatch):
    monkeypatch.setattr(questions, "PART_LINES", 1)
    whole = {r.product_key: r.n for r in questions.product_advice_lines(context).groupBy("product_key").count().withColumnRenamed("count", "n").collect()}
    rows = [r for r in questions.product_messages(context).collect() if r.product_key in whole]
    assert {k: sum(r.product_key == k for r in rows) for k in whole} == whole
    assert all(r.message.count("\n- [") == 1 and r.parts == whole[r.product_key] for r in rows)


NAMES = ["Tea", "Green Tea", "T", "Organic Green Tea Deluxe", "Ölfass", "organic", "x y", "Café au lait", "aaaaaaaa", "ab"]
TEXTS = [
    "green tea please", "ORGANIC GREEN TEA DELUXE now", "steam", "nothing", "ÖLFASS?", "organics", "x  y", "x y",
    "café AU LAIT", "aaaaaaa", "baaaaaaaab", "", None, "qqq" * 3000 + "Green Tea" + "z" * 500, "zzz",
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_mentions_match_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(questions, "fits_broadcast", lambda frame: broadcast)
    rows = [(f"P{i}", n, "X", float(100 - 7 * i % 40)) for i, n in enumerate(NAMES)] + [("P99", None, "X", 999.0)]
    products = spark.createDataFrame(rows, "product_id string, product_name string, category string, total_revenue double")
    got = {r.question_id: r.product_name for r in questions.product_mentions(asked(spark, TEXTS), products).collect()}
    ranked = [r[1] for r in sorted(rows, key=lambda r: (-r[3], r[0])) if r[1]]
    expected = {}
    for i, text in enumerate(TEXTS):
        hits = [n for n in ranked if text is not None and n.lower() in text.lower()]
        if hits:
            expected[str(i)] = hits[0]
    assert got == expected


def test_ask_refuses_an_invalid_ledger(spark, text_ledger):
    got = analysis.ask(asked(spark, ["top?"]), text_ledger({"closing_stock": "1"})).first()
    assert got.answer == analysis.INVALID_ANSWER and not got.is_valid and got.data_quality_score == 99


def test_ask_end_to_end(spark, shop):
    got = analysis.ask(asked(spark, ["Should I buy veggie burger?", "summary"]), shop).collect()
    answers = {r.question: r.answer for r in got}
    assert "Product analysis for Veggie Burger:" in answers["Should I buy veggie burger?"]
    assert "Inventory health score is 57/100. Total revenue is $525.00" in answers["summary"]
